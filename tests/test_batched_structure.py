"""Duplications, hairpins and domain changes of whole batches against those of one sequence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.config import DEFAULT, Config
from helixframe.functions import dna
from helixframe.operators import domains, structure, viterbi
from helixframe.operators.texts import Texts


def windows(n, letters="ACGT", sizes=(0, 1, 3, 5, 30, 220), seed=4):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.choice(sizes))) for _ in range(n)] + ["CA" * 20, "AAAAAAA", "CACA"]


def test_duplications_of_columns(spark):
    """As the same by expressions, which compared every pair of substrings; nulls, and texts over several chunks."""
    ref, alt = windows(900), windows(900, "AC", seed=9)
    rows = [(i, *p) for i, p in enumerate(zip(ref, alt))]
    df = spark.createDataFrame([*rows, (-1, None, "CACA"), (-2, "AC", None)], "i int, r string, a string").repartition(1)
    got = df.select("i", structure.duplications(F.col("r"), F.col("a")).alias("x"), dna.duplications(F.coalesce("r", F.lit("")), F.coalesce("a", F.lit(""))).alias("y")).collect()
    assert len(got) == len(rows) + 2 and all(r.x == r.y for r in got) and {r.i: r.x for r in got}[-1] == 1 and sum(r.x for r in got) > 100


def test_duplications_by_arrow(spark):
    from helixframe.plans import base

    plan = base.QUERIES["tandem_duplications"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


@pytest.mark.parametrize("size", [250, 60])
def test_domain_changes_of_batches(size):
    """Flanks shorter than any window, between two of them, and longer ones; empty alleles."""
    draw = random.Random(8)
    one = lambda k: "".join(draw.choices("ACGTN", k=k))
    rows = [(one(draw.choice([0, 1, 12])), one(draw.choice([0, 3, 40])), one(draw.choice([0, 7, 50, 100, 300])), one(draw.choice([0, 7, 50, 100, 300]))) for _ in range(80)]
    config = Config(hmm_window=size)
    got = domains.of_windows([Texts.of([r[k] for r in rows]) for k in (0, 1)], [Texts.of([r[k] for r in rows]) for k in (2, 3)], config)
    for row, (a, b, f, g) in zip(got, rows):
        want = []
        for scale in domains.SCALES.values():
            left, right = f[max(0, len(f) - int(size * scale)) :], g[: int(size * scale)]
            (r, p), (s, q) = (viterbi.decode([left + x + right]) for x in (a, b))
            want.append(domains.changes(r[0], s[0], q[0] - p[0], len(left)))
        assert row == pytest.approx(np.concatenate(want), abs=1e-9)
    assert domains.of_windows([Texts.of([])] * 2, [Texts.of([])] * 2, DEFAULT).shape == (0, len(domains.NAMES))
