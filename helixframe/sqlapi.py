"""Names for Spark SQL: `register(spark)` makes the features usable from spark.sql.

Three kinds of functions: SQL functions, whose bodies become part of the plan; vectorised functions on Arrow batches for
sequence algorithms; and table functions for candidate edits, `guided_edits(allele)` in SQL, to be joined by LATERAL, and
`edited(TABLE(...))`, which reads batches of a table with variant_id and alt_allele.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions.constants import GENE_DENSITY, stacking_energies
from .operators import align, incremental, orf, repair, structure, viterbi
from .operators.texts import Texts, text_udf

_map = lambda values: "map(" + ", ".join(f"{k!r}, {float(v)!r}D" for k, v in values.items()) + ")"
_strings = "array(" + ", ".join(f"'{s}'" for s in repair.appended()) + ")"
_cut = "concat(left(guided_edits.allele, p), substr(guided_edits.allele, p + k + 1))"

#: Name and parameters of each SQL function, what it returns and its body.
SQL_FUNCTIONS = {
    "gc_fraction(s STRING)": ("DOUBLE", "try_divide(length(s) - length(translate(s, 'GC', '')), length(s))"),
    "cpg_fraction(s STRING)": ("DOUBLE", "regexp_count(s, 'CG') / greatest(length(s) - 1, 1)"),
    "length_change(ref STRING, alt STRING)": ("DOUBLE", "try_divide(length(alt) - length(ref), length(ref)) * 100 * if(abs(length(alt) - length(ref)) % 3 <> 0, 2D, 1D)"),
    "gene_density(chromosome INT)": ("DOUBLE", f"try_element_at({_map(GENE_DENSITY)}, chromosome)"),
    "reverse_complement(s STRING)": ("STRING", "reverse(translate(s, 'ATCG', 'TAGC'))"),
    "stacking_energy(s STRING)": ("DOUBLE", f"aggregate(if(length(s) > 1, sequence(1, length(s) - 1), array()), 0D, (t, i) -> t + coalesce(try_element_at({_map(stacking_energies())}, substr(s, i, 2)), 0D))"),
    "variant_window(flank_1 STRING, allele STRING, flank_2 STRING)": ("STRING", (
        f"concat(right(flank_1, greatest(if(length(flank_1) >= {DEFAULT.dna_buffer}, {DEFAULT.dna_buffer}, least(length(flank_1), {DEFAULT.dna_buffer} - length(flank_1))), 0)), allele, left(flank_2, {DEFAULT.dna_buffer}))")),
    "guided_edits(allele STRING)": ("TABLE (candidate STRING)", (
        f"SELECT explode(array_distinct(concat(transform({_strings}, s -> concat(guided_edits.allele, s)), "
        f"flatten(transform(if(length(guided_edits.allele) - 3 >= {repair.KEPT_BASES}, sequence({repair.KEPT_BASES}, greatest(length(guided_edits.allele) - 3, {repair.KEPT_BASES})), array()), "
        f"p -> transform(array(0, 1, 2), k -> {_cut}))))))")),
}

_text = lambda s: s.fillna("").tolist()


def dna_alignment(ref: pd.Series, alt: pd.Series) -> pd.DataFrame:
    return align.dna_rows(_text(ref), _text(alt))


def dna_alignment_texts(ref: pd.Series, alt: pd.Series) -> pd.DataFrame:
    return align.dna_texts(_text(ref), _text(alt))


def protein_alignment(ref: pd.Series, alt: pd.Series) -> pd.DataFrame:
    return align.protein_rows(_text(ref), _text(alt), align.similarity())


def best_protein(texts: Texts) -> dict:
    return orf.found_proteins(texts, DEFAULT.min_protein, True)


def sequence_entropy(s: pd.Series) -> pd.Series:
    return pd.Series(structure.entropies(_text(s)))


def hairpins(s: pd.Series) -> pd.Series:
    return pd.Series(structure.hairpins(_text(s))).astype("int32")


def domain_path(s: pd.Series) -> pd.DataFrame:
    paths, total = viterbi.decode_all(_text(s))
    return pd.DataFrame({"path": paths, "log_probability": total})


VECTORISED = {
    "dna_alignment": (dna_alignment, align.DNA_NUMBERS), "dna_alignment_texts": (dna_alignment_texts, align.DNA_TEXTS), "protein_alignment": (protein_alignment, align.PROTEIN_SCHEMA),
    "sequence_entropy": (sequence_entropy, "double"), "hairpins": (hairpins, "int"), "domain_path": (domain_path, "path string, log_probability double"),
}


class Edited:
    """Guided edits of a table's alternate alleles, batch by batch; growth: bases more than the allele has."""

    def eval(self, table: pa.RecordBatch):
        ids, candidates, growth = [], [], []
        for key, allele in zip(table["variant_id"].to_pylist(), table["alt_allele"].to_pylist()):
            for s in dict.fromkeys((allele or "")[:kept] + tail for kept, tail in incremental.guided(allele or "")):
                ids.append(key)
                candidates.append(s)
                growth.append(len(s) - len(allele or ""))
        yield pa.table({"variant_id": pa.array(ids, pa.int64()), "candidate": pa.array(candidates, pa.string()), "growth": pa.array(growth, pa.int32())})


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, as temporary ones."""
    for head, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for name, (f, schema) in VECTORISED.items():
        spark.udf.register(name, F.pandas_udf(f, schema))
    spark.udf.register("best_protein", text_udf(best_protein, orf.FIELDS))
    spark.udtf.register("edited", F.arrow_udtf(Edited, returnType="variant_id long, candidate string, growth int"))
