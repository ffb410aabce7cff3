"""Reading frames and proteins of whole batches against those of one sequence."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import protein
from helixframe.functions.constants import PROPERTIES, RESIDUES
from helixframe.operators import orf
from helixframe.operators.texts import Texts


def sequences(n, seed=5):
    draw = random.Random(seed)
    made = ["", "A", "CT", "CTCTCTCTGAAATAA" * 3, "CTCTC" * 30, "ATG" + "GCN" * 12 + "TAR" + "TAA", "TAATAGATGAAATGA", "ATG" + "CAN" * 20 + "TGA" + "CTG" * 15 + "TAG", "atgé" * 20]
    return made + ["".join(draw.choices(letters, k=draw.choice([2, 3, 29, 40, 200, 500]))) for letters in ("ACGT", "ACGTACGTACGTN", "CT", "CTG", "ATGRYN-a") for _ in range(n)]


def test_found_proteins():
    made = sequences(60)
    for least in (10, 2):
        out = orf.found_proteins(Texts.of(made), least, True)
        rows = zip(*(x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() for x in (out[k] for k in orf.FIELDS)))
        for s, row in zip(made, rows):
            assert dict(zip(orf.FIELDS, row)) == orf.protein(s, least), s


def test_proteins_of_columns(spark):
    """Rows over several chunks and nulls; sums of properties as they are summed over residues."""
    made = sequences(300)
    df = spark.createDataFrame([(i, s) for i, s in enumerate([None, *made])], "i int, s string").repartition(1)
    got = df.select("i", orf.proteins(F.col("s")).alias("p"), orf.proteins(F.col("s"), residues=True).alias("q"), orf.first_frames(F.col("s")).alias("f"), protein.frame_0(F.col("s")).alias("g"))
    sums = [protein.residues_property_sum(F.col("q.residues"), k).alias(k) for k in PROPERTIES]
    for row in got.select("*", *sums).collect():
        want = orf.protein(made[row.i - 1] if row.i else "")
        assert row.q.asDict() == want and all(row.p[k] == want[k] for k in want if k != "residues")
        assert all(row.p[k] == pytest.approx(row[k], abs=1e-9) for k in PROPERTIES)
        assert row.f.protein == (row.g or "") and set(row.p.protein) <= set(RESIDUES + "X")
