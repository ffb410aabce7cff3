import numpy as np
import pytest

from helixframe.llm import ann


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.tolist().index(q)]
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = [int(i) for _, i in order]
    return out


def test_scan_keeps_what_is_near():
    rng = np.random.default_rng(0)
    c, q = rng.normal(size=(3000, 64)), rng.normal(size=(40, 64))
    rotation = np.linalg.qr(rng.normal(size=(65, 65)))[0]
    index = ann.Index(None, None, None, 1, (c**2).sum(1).max() * 1.0001, rotation, None, None, 20)
    s = q @ c.T
    bound = np.sort(s, axis=1)[:, -20]
    rows, cols = ann.scan(q, c, bound, index)
    kept = set(zip(rows.tolist(), cols.tolist()))
    want = {(i, j) for i in range(40) for j in np.flatnonzero(s[i] >= bound[i])}
    assert len(want & kept) / len(want) > 0.99 and len(kept) < 3 * len(want)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall(spark, table):
    sf = f"/root/testdata/{table}"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    queries = ids[ids % 20 == 0]
    want, got = brute(x, ids, queries, 20), {}
    for r in sorted(ann.op3_adaptive_scan(spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r)
    assert all([r["rank"] for r in got[q]] == list(range(1, 21)) for q in queries)
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 20 for q in queries]) >= 0.9
    r = got[queries[0]][0]
    assert abs(r.score - x[ids.tolist().index(r.vec_id)] @ x[ids.tolist().index(queries[0])]) < 1e-12


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0]), (160, [])]
    vectors = spark.createDataFrame([(*r, "c", 1.5) for r in rows], "vec_id long, embedding array<float>, list string, score double")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0"), 2).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 1, 1.0), (20, 2, 3, 1.0)]
    assert len(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()) == 3
    assert ann.search(vectors.where("vec_id > 30"), vectors.where("vec_id = 40"), 2).collect() == []
    assert ann.search(vectors.where("false"), vectors, 2).collect() == []
    twice = vectors.unionByName(vectors)
    assert sorted(ann.search(twice, twice.where("vec_id % 20 = 0"), 2).collect()) == sorted(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 2).collect())
    other = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 0.1]), (40, [2.0]), (41, [3.0]), (60, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    got = ann.search(other, other.where("vec_id % 20 = 0"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 1, 1.0), (40, 1, 41, 6.0)]
    many = spark.createDataFrame([(i, [1.0, 2.0, float(i % 3 == 0)]) for i in range(3000)], "vec_id long, embedding array<float>")
    got = ann.search(many, many.where("vec_id = 900"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 3, 6, 9, 12]


def test_doubles_and_short_results(spark, monkeypatch):
    """Scores of double vectors are exact; a query that the test leaves with too few is compared with all rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    vectors = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for certainty in (ann.CERTAINTY, -3.0):  # the latter abandons nearly all
        monkeypatch.setattr(ann.scan, "__defaults__", (certainty,))
        got = {}
        for r in sorted(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 7).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r)
            assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12
        want = brute(x, np.arange(400), range(0, 400, 20), 7)
        assert all(len(got[q]) == 7 for q in want)
        assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 7 for q in want]) >= 0.9


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e308])
def test_huge_and_tiny_doubles(spark, size):
    """Components whose squares overflow or vanish lose no row and no order."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0.1, 1, size=(60, 6))
    vectors = spark.createDataFrame([(i, [float(c) * size for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(vectors, vectors.where("vec_id % 20 = 0"), 5).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == (np.inf if size > 1 else 0.0) or size == 1e-200
    assert got == brute(x, np.arange(60), (0, 20, 40), 5)
