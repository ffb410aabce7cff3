"""Tables of vectors: which take part, packing, and coarse lists by k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, share_of

#: Rows that centroids are fitted on, rounds of k-means.
FIT_ROWS, FIT_ROUNDS = 20_000, 8


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, as floats if they are, else as doubles.

    Nulls, empty and zero vectors, and those with null or non-finite components take none.
    """
    if not vectors.schema["embedding"].dataType.simpleString() == "array<float>":
        vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("embedding").isNotNull())
    return ok.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())


def by_length(vectors: DataFrame) -> list[tuple[DataFrame, int, int]]:
    """(the vectors, their length, how many they are) for each length, the commonest first; others have no product with them.

    There are as many jobs as lengths.
    """
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    return [(vectors.where(F.size("embedding") == r["d"]) if len(sizes) > 1 else vectors, r["d"], r["count"]) for r in sizes]


def one_each(vectors: DataFrame) -> DataFrame:
    """Of rows that repeat a vec_id the smallest by component order; only such rows are shuffled."""
    again = cut(vectors.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if again.isEmpty():
        return vectors
    one = vectors.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return vectors.join(again, "vec_id", "left_anti").unionByName(one)


def as_numpy(vectors: DataFrame) -> type:
    return np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unpack(packed, dtype: type) -> np.ndarray:
    """Rows of packed vectors."""
    return np.frombuffer(b"".join(packed), dtype=dtype).reshape(len(packed), -1)


def sample(vectors: DataFrame, n: int, rows: int = FIT_ROWS, seed: int = 9) -> np.ndarray:
    """About so many vectors, picked by a hash of the id."""
    picked = vectors.where(share_of(F.col("vec_id"), seed, rows / n)) if n > rows else vectors
    got = picked.orderBy("vec_id").limit(2 * rows).select("embedding").toArrow()
    if not got.num_rows:
        got = vectors.orderBy("vec_id").limit(rows).select("embedding").toArrow()
    return matrix(got["embedding"].combine_chunks()).astype(np.float64) if got.num_rows else np.zeros((0, 0))


def centroids(x: np.ndarray, k: int, seed: int = 4) -> np.ndarray:
    """k-means with seeded starts; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        of = nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, of equally near ones the first."""
    return (np.einsum("ij,ij->i", c, c) - 2 * x @ c.T).argmin(1)
