import numpy as np

from helixframe.llm import langid

EN = "the house and the garden are with this that which was there "
DE = "das haus und der garten sind nicht mit einem aber wir haben "


def brute(like, rounds=langid.ROUNDS):
    """Proportions of one document by plain loops."""
    n = len(like)
    pi = [1 / n] * n
    for _ in range(rounds):
        total = [0.0] * n
        for w in range(like.shape[1]):
            p = [pi[k] * np.exp(like[k, w]) for k in range(n)]
            for k in range(n):
                total[k] += p[k] / sum(p)
        pi = [t / like.shape[1] for t in total]
    return pi


def test_mixture_as_loops():
    rng = np.random.default_rng(0)
    like = rng.normal(size=(3, 40)).astype(np.float32) * 2
    full, chosen = langid.mixture(like, np.array([0, 25]), np.array([25, 15]))
    assert np.allclose(full[:, 0], brute(like[:, :25]), atol=1e-4)
    assert np.allclose(full[:, 1], brute(like[:, 25:]), atol=1e-4)
    assert np.allclose(chosen.sum(0), 1, atol=1e-4)


def test_edge_texts_and_heldout(spark):
    rows = [(i, (EN if i % 2 else DE) * 3, "en" if i % 2 else "de", "x") for i in range(60)]
    rows += [(100, None, None, "x"), (101, "", "en", "x"), (102, "123 !?", None, "x"), (103, EN * 5000, None, "x"), (104, DE * 2 + EN * 2, None, "x")]
    rows += [(1, EN * 3, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "en" and set(x.split(":")[0] for x in got[104].lang_set.split(",")) == {"en", "de"}
    assert langid.predict(docs.where("false"), langid.fit(docs)).collect() == []
    nothing = langid.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    kept = langid.keep_identified(docs, 0.35)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(60), 103, 104}


def test_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op5_language_mixture(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
