from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from helixframe.llm import mixing
from helixframe.llm.mixing import Recipe, budgets, share_out


def test_share_out():
    one = Fraction(1)
    assert share_out(10, [one, one], [100, 100]) == [5, 5]
    assert share_out(10, [one, one, one], [1, 100, 100]) == [1, 5, 4]
    assert share_out(10, [one, Fraction(0)], [4, 100]) == [4, 0]
    assert share_out(10, [3 * one, one], [100, 100]) == [8, 2] or sum(share_out(10, [3 * one, one], [100, 100])) == 10
    assert share_out(5, [], []) == []


def test_siblings_before_ancestors():
    tokens = {("a", "x", "s"): 10, ("a", "y", "s"): 1000, ("b", "x", "s"): 1000}
    got = budgets(tokens, Recipe(tokens=400, most_epochs=1))
    # a gets its 200 in spite of x's shortage, which y makes up for
    assert got == {("a", "x", "s"): 10, ("a", "y", "s"): 190, ("b", "x", "s"): 200}
    got = budgets({("a", "x", "s"): 10, ("a", "y", "s"): 20, ("b", "x", "s"): 1000}, Recipe(tokens=400, most_epochs=1))
    assert got == {("a", "x", "s"): 10, ("a", "y", "s"): 20, ("b", "x", "s"): 370}


def brute(rows, recipe, places):
    """Copies of each row by plain loops over the leaves; places: hash of (epoch, doc_id)."""
    leaves = defaultdict(list)
    for i, (doc, n, leaf) in enumerate(rows):
        if n:
            leaves[leaf].append((doc, n, i))
    given = budgets({k: sum(n for _, n, _ in v) for k, v in leaves.items()}, recipe)
    copies = Counter()
    for leaf, docs in leaves.items():
        whole, rest = divmod(given[leaf], sum(n for _, n, _ in docs))
        for _, _, i in docs:
            copies[i] += whole
        for doc, n, i in sorted(docs, key=lambda d: (places[whole, d[0]], d[0])):
            rest -= n
            if rest < 0:
                break
            copies[i] += 1
    return copies


def test_query_as_brute_force(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("epoch", F.lit("clash"))
    domain = mixing.domain_of(F.col("source"))
    rows = docs.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n"), domain.alias("d"), "lang", "source").collect()
    ids = spark.createDataFrame([(r.doc_id,) for r in rows], "_id long")
    for recipe in (mixing.RECIPE, Recipe(share=1.7, most_epochs=3, domains={"domain1": 0.0}), Recipe(tokens=5)):
        places = {(e, r._id): r.p for e in range(4) for r in ids.withColumn("p", mixing.place(F.lit(e), recipe.seed)).collect()}
        want = brute([(r.doc_id, r.n, (r.d, r.lang, r.source)) for r in rows], recipe, places)
        for ranges in (2048, 3):
            monkeypatch.setattr(mixing, "RANGE_DOCS", ranges)
            made = mixing.mix(docs, domain, recipe)
            assert made.columns == [*docs.columns, "_epoch"]
            got = Counter(r.doc_id for r in made.collect())
            assert got == Counter({rows[i].doc_id: n for i, n in want.items() if n})


def test_edges(spark):
    rows = [(1, None, None, None), (2, " \n", "en", "s"), (3, "a b c", None, "s"), (None, "d e", "en", None), (4, "w " * 50_000, "en", "s"), (4, "w " * 50_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, mixing.domain_of(F.col("source")), Recipe(share=2.0, most_epochs=2)).collect()
    assert Counter(r.doc_id for r in got) == {3: 2, None: 2, 4: 4}
    names = ["_epoch", "_EPOCH_", "_domain", "_lang", "_source", "_id", "_whole", "_cut_place", "_cut_id", "_doc", "_nth", "_has_words", "n"]
    clashing = docs.select("*", *[F.lit("x").alias(n) for n in names])
    got = mixing.mix(clashing, mixing.domain_of(F.col("source")), Recipe(share=2.0, most_epochs=2))
    assert got.columns == [*clashing.columns, "_epoch__"] and Counter(r.doc_id for r in got.collect()) == {3: 2, None: 2, 4: 4}
    assert mixing.mix(clashing, F.lit("d"), Recipe(), epoch=None).columns == clashing.columns
    assert mixing.mix(docs.where("false"), F.lit("d"), Recipe()).collect() == []
    assert mixing.mix(docs, F.lit("d"), Recipe(other=0.0)).collect() == []
