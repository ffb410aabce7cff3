"""The pipeline's stages against plain versions of each, and on rows that are hard."""

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from helixframe.llm import bpe, langid, mixing, secrets
from test_mixing import brute as brute_mix
from test_simhash import brute_components, brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_redaction(text):
    spans = secrets.base_spans(text)
    spans = sorted(spans + secrets.novel_spans(text, spans, secrets.Novelty(), secrets.NOVELTY))
    out, at = "", 0
    for a, _, b in spans:
        if b > at:
            out += text[at:a] + "[SECRET]" if a >= at else ""
            at = b
    return out + text[at:] if spans else text


def test_stages_as_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_dedup", "secret_scan", "mixing", "bpe"]

    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    _, share, _ = langid.identify([r.text for r in rows.values()], model)
    want = {i for i, s in zip(rows, share) if s >= corpus_pipeline.LEAST_SHARE}
    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == want

    components = brute_components({i: brute_print(rows[i].text) for i in want})
    want = {i for i in want if components[i] == i}
    kept = stages["simhash_dedup"](spark, kept, sf)
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == want

    clean = {i: plain_redaction(rows[i].text) for i in want}
    kept = stages["secret_scan"](spark, kept, sf)
    assert kept.columns == COLUMNS and {r.doc_id: r.text for r in kept.collect()} == clean
    assert all(r.n_chars == len(r.text) for r in kept.collect())

    sized = kept.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n"), mixing.domain_of(F.col("source")).alias("d"), "lang", "source").collect()
    ids = spark.createDataFrame([(r.doc_id,) for r in sized], "_id long")
    places = {(e, r._id): r.p for e in range(3) for r in ids.withColumn("p", mixing.place(F.lit(e), mixing.RECIPE.seed)).collect()}
    copies = brute_mix([(r.doc_id, r.n, (r.d, r.lang, r.source)) for r in sized], mixing.RECIPE, places)
    mixed = stages["mixing"](spark, kept, sf)
    wanted = Counter({sized[i].doc_id: n for i, n in copies.items() if n})
    assert mixed.columns == COLUMNS and Counter(r.doc_id for r in mixed.collect()) == wanted

    encoder = bpe.WordBpe(bpe.load())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == wanted
    for r in got:
        ids = encoder.encode(clean[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(encoder.decode(ids)))


def test_hard_rows(spark):
    text = "the house and the garden are with this that which was there " * 4
    rows = [(i, text + f" number{i} " * (i % 7 + 1), "en", None if i % 5 else "s", 1, "x") for i in range(40)]
    rows += [(50, None, "en", "s", None, None), (51, "", None, None, 0, "x"), (None, text + "a null id here", "en", "s", 3, "x"), (52, text * 3000, None, "s", 5, "x"), (3, rows[3][1], "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    names = ["_epoch", "_domain", "_id", "_doc", "_gone", "_key", "_nth", "fp", "component_id", "node", "lang_pred", "spans", "n_tokens", "row"]
    clashing = docs.select("*", *[F.lit("x").alias(n) for n in names])
    for given in (docs, clashing, docs.where("false"), docs.where("doc_id in (50, 51)")):
        out = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == given.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, out, "")
        assert last.count() <= 2 * given.count()
