"""The training-data operators' registered queries."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, embdedup, fim, langid, mixing, passages, periodic, secrets, simhash, tokencount, toxicity, urlfilter

QUERIES = {
    "op1_toxicity_mil": toxicity.op1_toxicity_mil,
    "op2_url_interval_join": urlfilter.op2_url_interval_join,
    "op3_adaptive_scan": ann.op3_adaptive_scan,
    "op4_simhash_gray": simhash.op4_simhash_gray,
    "op5_language_mixture": langid.op5_language_mixture,
    "op6_int8_tiles": embdedup.op6_int8_tiles,
    "op7_collinear_chains": passages.op7_collinear_chains,
    "op8_bpe_roundtrip": bpe.op8_bpe_roundtrip,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_hierarchical_mix": mixing.op10_hierarchical_mix,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_token_counts": tokencount.op13_token_counts,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_url_interval_join": urlfilter.ORACLE, "op11_periodic_runs": periodic.ORACLE, "op12_fill_in_middle": fim.ORACLE}
