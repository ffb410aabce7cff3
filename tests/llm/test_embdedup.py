import numpy as np
import pytest

from helixframe.llm import embdedup


def brute(x, ids, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    root = {int(i): int(i) for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(near)):
        p, q = sorted((find(int(ids[a])), find(int(ids[b]))))
        root[q] = p
    return {int(i): (int(n), find(int(i))) for i, n in zip(ids, near.sum(1))}


def near_copies(rng, n, d, noise):
    centres = rng.normal(size=(n // 20, d))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * rng.uniform(0, noise, (n, 1))


@pytest.mark.parametrize("d", [3, 64, 1500])
def test_pairs_as_brute_force(d):
    rng = np.random.default_rng(d)
    u = embdedup.unit(near_copies(rng, 1300 if d < 1000 else 300, d, 0.6))
    want = np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist()
    got = [[int(a), int(b)] for x, y in embdedup.near_pairs(u, None, 0.9) for a, b in zip(x, y)]
    assert sorted(got) == want
    half = len(u) // 2
    crossed = sorted([int(a), int(b) + half] for x, y in embdedup.near_pairs(u[:half], u[half:], 0.9) for a, b in zip(x, y))
    assert crossed == [[a, b] for a, b in want if a < half <= b]


def test_blocks_and_lists(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = near_copies(rng, 600, 8, 0.5).astype(np.float32)
    monkeypatch.setattr(embdedup, "BLOCK_ROWS", 40)
    monkeypatch.setattr(embdedup, "LIST_ROWS", 60)
    vectors = spark.createDataFrame([(i * 7, [float(c) for c in r], i) for i, r in enumerate(x)], "vec_id long, embedding array<float>, list int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_vectors(vectors).collect()}
    assert got == brute(x.astype(float), np.arange(600) * 7, 0.9)


def test_query_as_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.op6_int8_tiles(spark, sf).collect()}
    assert got == brute(np.stack(e.embedding).astype(float), e.vec_id.to_numpy(), 0.9)


def test_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (2, [2.0, 0.0]), (9, [1e-30, 0.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_vectors(vectors).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8)}
    assert embdedup.near_vectors(vectors.where("false")).collect() == []
    assert [r.kept for r in embdedup.near_vectors(vectors.where("vec_id = 4")).collect()] == [True]


def test_lengths_and_doubles(spark):
    """Vectors of every length are linked with those of their own; repeated ids count once."""
    near = 0.9 + 1e-9  # told apart from 0.9 only in double precision
    rows = [(1, [1.0, 0.0]), (2, [near, (1 - near**2) ** 0.5]), (3, [0.9 - 1e-9, (1 - (0.9 - 1e-9) ** 2) ** 0.5]), (4, [2.0]), (5, [3.0]), (5, [3.0]), (6, [-1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_vectors(vectors).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
