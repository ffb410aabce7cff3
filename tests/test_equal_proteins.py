"""Pairs of equal proteins are neither aligned nor searched, and others as before."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.config import DEFAULT
from helixframe.functions.constants import RESIDUES
from helixframe.operators import align, motifs
from helixframe.operators.texts import Texts


def pairs():
    draw = random.Random(2)
    one = lambda letters=RESIDUES: "".join(draw.choices(letters, k=draw.choice([0, 1, 9, 40])))
    made = [(x, x) for x in (one() for _ in range(30))] + [(one(), one()) for _ in range(30)] + [(x, x) for x in ("X", "AXA", "*", "é", "")]
    return made + [(x, x[:5] + "W" + x[6:]) for x in ("ACDEFGHIKL", "KRKRKKRGYKAF")] + [(None, "ACD"), (None, None)]


@pytest.mark.parametrize("scores", [None, {("A", "A"): 1, ("C", "C"): 1, ("A", "C"): 3, ("C", "A"): 3}])
def test_alignments_of_equal_proteins(spark, scores):
    table = scores or align.similarity()
    assert align.alike_best(table, -8) == (scores is None) and not align.alike_best(table, 0)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs())], "i int, a string, b string").repartition(1)
    want = align.protein_rows([a or "" for a, _ in pairs()], [b or "" for _, b in pairs()], table).to_dict("records")
    got = df.select("i", align.protein_alignments(F.col("a"), F.col("b"), scores).alias("x")).collect()
    assert [r.x.asDict() for r in sorted(got, key=lambda r: r.i)] == want


def test_only_changed_proteins_are_searched():
    seen = []

    def run(a, b):
        seen.extend(zip(a.strings(), b.strings()))
        return {"x": np.ones(len(a))}

    a, b = (Texts.of(t) for t in (["AC", "A", "", "AC"], ["AC", "AC", "A", "AD"]))
    assert motifs.where_changed(run, ["x"])(a, b)["x"].tolist() == [0, 1, 1, 1] and seen == [("A", "AC"), ("", "A"), ("AC", "AD")]


def test_protein_profile_of_columns(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs())], "i int, a string, b string")
    want = motifs.protein_profile(*(pd.Series([x or "" for x in side]) for side in zip(*pairs())), motifs.PROTEIN_MOTIFS, DEFAULT).to_dict("records")
    got = df.select("i", motifs.protein_motifs(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x.asDict() for r in sorted(got, key=lambda r: r.i)] == want


def test_batches_without_texts(spark):
    df = spark.createDataFrame([(None, None, None, None), ("", "", "", "")], "a string, b string, f string, g string")
    for rows, n in ((df, 2), (df.where("false"), 0)):
        made = rows.select(motifs.dna_motifs(*(F.col(c) for c in "abfg")).alias("x"), align.protein_alignments(F.col("a"), F.col("b")).alias("y")).collect()
        assert len(made) == n and not any(any(r.x) or any(r.y) for r in made)
