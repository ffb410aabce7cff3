import math

import numpy as np

from helixframe.llm import toxicity


def test_noisy_or():
    z = np.array([-1.0, 0.5, 2.0])
    assert math.isclose(toxicity.noisy_or(z), 1 - np.prod(1 - 1 / (1 + np.exp(-z))))
    assert toxicity.noisy_or(np.zeros(0)) == 0.0


def test_sentences():
    model = toxicity.Model(-3.0, {"=bad": 4.0, "^awfu": 2.0})
    words = toxicity.Words(model)
    text = "!! A bad thing.\nFine here? Awfully bad bad"
    assert np.allclose(toxicity.sentence_logits(text, words), [1.0, -3.0, -3 + 2 + 8])
    assert [text[int(a) : int(b)] for a, b in (s.split(":") for s in toxicity.offending(text, words, 0.5).split(","))] == ["A bad thing.\n", "Awfully bad bad"]
    for empty in ("", "...", "\n"):
        assert len(toxicity.sentence_logits(empty, words)) == 0 and toxicity.offending(empty, words, 0.5) == ""


def test_training_locates(spark):
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        said = [f"plain words number{(i * 7 + j) % 23} stand here" for j in range(4)] + (["you horrid fool"] if toxic else [])
        rows.append((i, ". ".join(said), 5.0))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, "fine " * 40_000 + ". you horrid fool", 0.0), (0, rows[0][1], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200))
    assert got[900].score == got[901].score == 0.0 and got[902].predicted == 1
    a, b = map(int, got[902].sentences.split(",")[-1].split(":"))
    assert rows[202][1][a:b] == "you horrid fool"
    assert toxicity.score(docs.where("false"), model).collect() == []
    nothing = toxicity.fit(docs, marks.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity_mil(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    hit = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.05
