"""Window scores of whole batches against the definition, window by window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.constants import RESIDUES, SYMBOLS
from helixframe.operators import motifs
from helixframe.plans import base


def plain_scores(s, m):
    odds, void = m.odds()
    out = []
    for i in range(len(s) - m.size + 1):
        at = [m.symbols.find(c) if c in m.symbols else len(m.symbols) - (m.symbols == SYMBOLS) for c in s[i : i + m.size]]
        out.append(0.0 if any(void[k, c] for k, c in enumerate(at)) else sum((odds[k, c] for k, c in enumerate(at)), 0.0))
    return out


@pytest.mark.parametrize("symbols,letters,found", [(SYMBOLS, "ACGTACGTN", motifs.DNA_MOTIFS), (RESIDUES, RESIDUES + "X*", motifs.PROTEIN_MOTIFS + motifs.PDZ_MOTIFS)])
def test_scores_of_batches(symbols, letters, found):
    draw = random.Random(3)
    texts = ["".join(draw.choices(letters, k=draw.choice([0, 1, 7, 40]))) for _ in range(60)]
    batch = motifs.Batch(texts, symbols)
    for m in found:
        want = [(i, k, x) for i, s in enumerate(texts) for k, x in enumerate(plain_scores(s, m))]
        assert [(int(a), int(b), float(c)) for a, b, c in zip(*batch.windows(m))] == want
        high = batch.hits(*batch.scores(m), m.threshold(0.7))
        assert [(int(a), int(b), float(c)) for a, b, c in zip(*high)] == [x for x in want if x[2] >= m.threshold(0.7)]


def test_strict_windows():
    """A window with a symbol of no motif scores 0 by itself, whatever its others say."""
    m = motifs.from_consensus("m", "SH2", "YxN", alphabet=RESIDUES)
    score, inside = motifs.Batch(["YAN", "YXN", "YANX"], RESIDUES, strict=True).scores(m)
    plain = plain_scores("YAN", m)[0]
    assert score[inside].tolist() == [plain, 0.0, plain, 0.0]


def test_windows_of_columns(spark):
    """Nulls and short texts; texts beyond one chunk and one batch."""
    m = motifs.from_consensus("m", "init", "ACGN")
    rows = [(1, None, "ACGTACGT"), (2, "AC", ""), (3, "ACGTACGTAC", "TTTT")] + [(i, "ACGTA" * 40, "ACG" * (i % 50)) for i in range(4, 3000)]
    df = spark.createDataFrame(rows, "id long, r string, a string").repartition(1)
    got = {x.id: x for x in df.select("id", motifs.window_statistics(F.col("r"), [m]).alias("s"), motifs.score_deltas(F.col("r"), F.col("a"), [m], 0.9).alias("d"), motifs.hit_deltas(F.col("r"), F.col("a"), [m], 0.9, 50).alias("h")).collect()}
    assert (got[1].s.m_n, got[1].s.m_max, got[1].s.m_sum) == (0, None, 0.0) and got[2].s.m_max is None
    for i, r, a in rows[:200] + rows[-50:]:
        x, (before, after) = got[i], (plain_scores(s or "", m) for s in (r, a))
        assert x.s.m_n == len(before) and x.d.m_count == len(after) - len(before)
        assert x.d.m_score == pytest.approx(sum(after) - sum(before)) and x.d.m_hits == x.h.hits == sum(y >= m.threshold(0.9) for y in after) - sum(y >= m.threshold(0.9) for y in before)


def without_lambdas(df):
    return "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["pwm_cluster_delta", "pwm_domain_cluster", "pwm_gaussian_delta", "pwm_totals", "pwm_window_scores"])
def test_windows_are_not_scored_one_by_one(spark, name):
    """Scores used to be looked up symbol by symbol in a list of all a motif's scores."""
    assert without_lambdas(base.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_distances_and_weights():
    batch = motifs.Batch(["ACGTACGT", "AC"], SYMBOLS)
    far = motifs.distances(batch, np.array([2, 0]), np.array([4, 0]))
    assert far.tolist() == [2, 1, 0, 0, 0, 1, 2, 3, 0, 1]
    assert motifs.weights(far, 3).tolist() == pytest.approx(motifs.gaussian(batch.place, np.array([2, 0])[batch.of], np.array([4, 0])[batch.of], 3).tolist())
