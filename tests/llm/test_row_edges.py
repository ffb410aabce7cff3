import pytest

from helixframe.llm import bpe, langid, secrets, toxicity

TEXTS = ["you are a worthless fool and I hate you", "a kind and gentle day in the garden"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXTS[i % 2], "en" if i % 2 else "fr", "x", 1.0, "y") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, spans string, score double, predicted string")


def results(docs, scored):
    """What each operator gives, by name."""
    labels = docs.selectExpr("doc_id", "int(doc_id % 2 = 0) AS toxic").distinct()
    return {
        "toxicity": toxicity.score(scored, toxicity.fit(docs, labels)), "langid": langid.predict(scored, langid.fit(docs)),
        "secrets": secrets.scan(scored), "bpe": bpe.digests(scored),
    }


def test_repeats_clashes_and_nothing(docs):
    """Repeated rows give repeated, equal rows, columns named like results do no harm, and nothing gives nothing."""
    few = docs.where("doc_id < 4")
    once, twice, none = (results(docs, x) for x in (few, few.unionByName(few), few.where("false")))
    for name, made in once.items():
        rows = sorted(map(tuple, made.collect()))
        assert len(rows) == 4 and sorted(map(tuple, twice[name].collect())) == sorted(rows * 2), name
        assert none[name].collect() == [] and none[name].columns == made.columns, name
