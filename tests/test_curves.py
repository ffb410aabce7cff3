import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helixframe.plans import learning

SCORES = {
    "crowded": st.integers(0, 10**6).map(lambda i: 0.5 + i * 1e-12),
    "far": st.sampled_from([-1e9, 1e9, -1e300, 1e300, 0.0, -0.0, 3.5]),
    "odd": st.sampled_from([None, math.nan, math.inf, -math.inf, 0.25, -0.0, 0.0]),
}
ROW = st.tuples(st.one_of(*SCORES.values()), st.sampled_from([0, 0, 1, 1, None]))


def rank(x):
    """Null lowest, NaN highest; equal zeros."""
    return (0, 0.0) if x is None else (2, 0.0) if math.isnan(x) else (1, x + 0.0)


def plain(rows):
    known = [(rank(s), y) for s, y in rows if y is not None]
    out = {}
    for r in {r for r, _ in known}:
        at = [y for q, y in known if q == r]
        over = [y for q, y in known if q >= r]
        out[r] = (sum(at), len(at) - sum(at), sum(over), len(over) - sum(over))
    return out


@pytest.mark.parametrize("ranges", [256, 3])
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(ROW, max_size=40))
def test_counts_as_plain(spark, monkeypatch, ranges, rows):
    monkeypatch.setattr(learning, "RANGES", ranges)
    df = spark.createDataFrame(rows, "s double, y int")
    got = learning.by_score(df, "s", "y").collect()
    assert {rank(r.score): (r.pos, r.neg, r.tp, r.fp) for r in got} == plain(rows) and len(got) == len(plain(rows))


@pytest.mark.parametrize("scores", [[0.5 + i * 1e-9 for i in range(3000)], [(-1) ** i * 1e9 + i for i in range(3000)], [None, math.nan] * 20 + [i % 7 for i in range(400)]])
def test_metrics_as_plain(spark, scores):
    rows = [(s, int((i * 7919) % 5 < 2)) for i, s in enumerate(scores)]
    df = spark.createDataFrame([(None if s is None else float(s), y) for s, y in rows], "s double, y int")
    pos, neg = sorted(rank(s) for s, y in rows if y), sorted(rank(s) for s, y in rows if not y)
    from bisect import bisect_left, bisect_right

    wins = sum(bisect_left(neg, p) + (bisect_right(neg, p) - bisect_left(neg, p)) / 2 for p in pos)
    assert learning.roc_auc(df, "s", "y").first()[0] == pytest.approx(wins / len(pos) / len(neg))
    counts = plain(rows)
    f1 = max(2 * tp / (tp + fp + len(pos)) for _, _, tp, fp in counts.values())
    assert learning.best_f1(df, "s", "y").first().f1 == pytest.approx(f1)
    area, last = 0.0, 1.0
    for r in sorted(counts, reverse=True):
        p, _, tp, fp = counts[r]
        area, last = area + p * (tp / (tp + fp) + last) / 2, tp / (tp + fp)
    assert learning.pr_auc(df, "s", "y").first()[0] == pytest.approx(area / len(pos))


def test_empty_and_single_labels(spark):
    none = spark.createDataFrame([], "s double, y int")
    assert learning.roc_auc(none, "s", "y").first()[0] is None and learning.by_score(none, "s", "y").collect() == []
    one = spark.createDataFrame([(0.5, 1), (0.25, 1)], "s double, y int")
    assert learning.roc_auc(one, "s", "y").first()[0] is None and learning.pr_auc(one, "s", "y").first()[0] == pytest.approx(1.0)
