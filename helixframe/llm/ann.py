"""Nearest neighbours by largest inner product: coarse lists and an adaptive dimension scan.

One more component makes all vectors equally long, so the largest inner product is the smallest distance.  Vectors
are dealt to the lists of a k-means fit; a query probes the lists whose centroids are nearest.  Within a list both
sides are rotated at random and distances grow column block by column block: after each block a hypothesis
test abandons candidates whose partial distance is too large for a full one within the query's bound.
The rest are scored in double precision on the original vectors.

How many lists a query probes is measured on the fit's sample for a wanted recall.  A query's first bound is its
inner product with a near neighbour among the sample's vectors in those lists, LOOSE times as far down as wanted,
so that the test's rare errors still leave it enough.  Lists and queries are
dealt in blocks of bounded size, so a list that holds a third of all rows is many tasks.

Vectors that take no part are neither queries nor candidates.  Rows that repeat an id are one vector, the smallest by
component order; a vector is not its own candidate.  Ties go to the smaller vec_id.  With fewer candidates than wanted all are returned.
Vectors of doubles whose squares could overflow or vanish are searched scaled by one power of two: they are ranked by the scaled
products, and a score that no double holds is infinite.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .vectors import as_numpy, by_length, centroids, matrix, nearest, one_each, sample, unpack, usable

#: Rows of a list on average, most lists, rows of a block of candidates and of queries, components in a column block.
LIST_ROWS, MOST_LISTS, BLOCK_ROWS, QUERY_ROWS, COLUMNS = 512, 1024, 1024, 1024, 16
#: Recall wanted of the probes on the sample; how sure the test is before it abandons; rows that give the first bound.
RECALL, CERTAINTY, BOUND_ROWS, LOOSE = 0.975, 2.4, 4096, 2


#: Largest components between which vectors are taken as they are.
SAFE = (2.0**-200, 2.0**400)
#: One of so many probed lists is scanned in the first round.
FIRST_LISTS = 8


@dataclass
class Index:
    """What all tasks share, of bounded size: centroids, sizes of the lists, rotation and the sample for first bounds."""

    lists: np.ndarray
    sizes: np.ndarray
    blocks: np.ndarray
    probes: int
    length2: float
    rotation: np.ndarray
    known: np.ndarray
    known_of: np.ndarray
    k: int
    dtype: type = np.float32


def longer(x: np.ndarray, length2: float) -> np.ndarray:
    """Candidates with the component that makes all of them equally long."""
    rest = np.sqrt(np.maximum(0.0, length2 - np.einsum("ij,ij->i", x, x)))
    return np.c_[x, rest]


def probes_needed(x: np.ndarray, lists: np.ndarray, of: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that queries from the sample find this share of their neighbours in it."""
    q = x[:: max(1, len(x) // 256), :-1]
    scores = q @ x[:, :-1].T
    scores[np.arange(len(q)), np.arange(len(x))[:: max(1, len(x) // 256)]] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(lists)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    far = np.einsum("ij,ij->i", lists, lists) - 2 * q @ lists[:, :-1].T
    place = far.argsort(1, kind="stable").argsort(1, kind="stable")  # of each list among a query's
    needed = np.sort(np.take_along_axis(place, of[best], 1).ravel())
    return int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1


def build(vectors: DataFrame, k: int, recall: float = RECALL) -> Index:
    """Fit the lists on a bounded sample, then count all rows of each list."""
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    seen = vectors.agg(F.count("*").alias("n"), F.max(norm2).alias("length2")).first()
    x = sample(vectors, seen["n"])
    x = longer(x, length2 := seen["length2"] * (1 + 1e-9))
    lists = centroids(x, int(np.clip(seen["n"] // LIST_ROWS, 1, MOST_LISTS)))
    rotation = np.linalg.qr(np.random.default_rng(6).normal(size=(x.shape[1],) * 2))[0]
    of = nearest(x, lists)
    none = np.zeros(len(lists), dtype=np.int64)
    index = Index(lists, none, none, probes_needed(x, lists, of, k, recall), length2, rotation, x[:BOUND_ROWS, :-1], of[:BOUND_ROWS], k, as_numpy(vectors))
    for r in listed(vectors, index).groupBy("list").count().collect():  # at most MOST_LISTS
        index.sizes[r["list"]] = r["count"]
    index.blocks = -(-index.sizes // BLOCK_ROWS)
    return index


def listed(vectors: DataFrame, index: Index) -> DataFrame:
    """(vec_id, vec, list, block) of each candidate."""
    made = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = made.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            of = nearest(longer(x.astype(np.float64), ix.length2), ix.lists)
            ids = b.column(0).to_numpy()
            block = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(1, ix.blocks[of])
            packed = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed), pa.array(of.astype(np.int32)), pa.array(block.astype(np.int32))], names=["vec_id", "vec", "list", "block"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary, list int, block int")


def probing(queries: DataFrame, index: Index, every: bool = False) -> DataFrame:
    """(vec_id, vec, bound, list, nth): each query once for every list it probes, the nearest list first; or for every list, without a bound."""
    made = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = made.value
        for b in batches:
            if not b.num_rows:
                continue
            given, ids = matrix(b.column(1)), b.column(0)
            x = given.astype(np.float64)
            far = np.einsum("ij,ij->i", ix.lists, ix.lists) - 2 * x @ ix.lists[:, :-1].T
            order = far.argsort(1, kind="stable")
            # at least the wanted probes, and as many as hold k others
            held = np.cumsum(ix.sizes[order], axis=1) < ix.k + 1
            take = np.maximum(ix.probes, held.sum(1) + 1).clip(max=order.shape[1])
            if every:
                take[:] = order.shape[1]
            bound = np.full(len(x), -np.inf) if every else first_bounds(x, order, take, ix)
            row = np.repeat(np.arange(len(x)), take)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            chosen = np.concatenate([o[:t] for o, t in zip(order, take)])
            packed = np.array([r.tobytes() for r in given], dtype=object)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(packed[row], type=pa.binary()), pa.array(bound[row]), pa.array(chosen.astype(np.int32)), pa.array(nth.astype(np.int32))], names=["vec_id", "vec", "bound", "list", "nth"])

    return queries.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary, bound double, list int, nth int")


def first_bounds(x: np.ndarray, order: np.ndarray, take: np.ndarray, index: Index) -> np.ndarray:
    """An inner product for each query that more than enough sample vectors in the lists it probes reach."""
    bound, near = np.full(len(x), -np.inf), LOOSE * (index.k + 1)
    if len(index.known) <= near:
        return bound
    for at in range(0, len(x), 512):
        here = slice(at, at + 512)
        probed = np.zeros((len(x[here]), order.shape[1]), dtype=bool)
        np.put_along_axis(probed, order[here], np.arange(order.shape[1]) < take[here, None], axis=1)
        scores = np.where(probed[:, index.known_of], x[here] @ index.known.T, -np.inf)
        bound[here] = np.partition(scores, -near, axis=1)[:, -near] - 1e-6 * index.length2
    return bound


def scan(q: np.ndarray, c: np.ndarray, bound: np.ndarray, index: Index, certainty: float = CERTAINTY):
    """(query row, candidate row) pairs that the adaptive scan does not abandon.

    bound: inner products that queries' results must reach.
    """
    a = np.c_[q, np.zeros(len(q))] @ index.rotation
    b = longer(c, index.length2) @ index.rotation
    d = a.shape[1]
    # inner products as distances: all candidates are equally long
    far = np.einsum("ij,ij->i", q, q) + index.length2 - 2 * np.where(np.isfinite(bound), bound, -index.length2 - 1e30)
    far = np.maximum(far, 0.0) + 1e-9 * (1 + index.length2)
    rows = cols = part = None
    for start in range(0, d, COLUMNS):
        end = min(d, start + COLUMNS)
        x, y = a[:, start:end], b[:, start:end]
        if rows is None:
            full = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * x @ y.T
            rows, cols = np.nonzero(full <= far[:, None] * test(end, d, certainty))
            part = full[rows, cols]
        else:
            part = part + ((x[rows] - y[cols]) ** 2).sum(1)
            on = part <= far[rows] * test(end, d, certainty)
            rows, cols, part = rows[on], cols[on], part[on]
    return rows, cols


def test(seen: int, of: int, certainty: float) -> float:
    """Share of the distance that so many of the rotated components exceed only by chance."""
    return 1.0 if seen >= of else seen / of * (1 + certainty / np.sqrt(seen)) ** 2


def within(group: pd.DataFrame, index: Index) -> pd.DataFrame:
    """The best k candidates of one block for each query of one block."""
    asks = group["bound"].notna().to_numpy()
    asked, given = group[asks], group[~asks].sort_values("vec_id")
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(asked) and len(given):
        q, c = unpack(asked["vec"], index.dtype).astype(np.float64), unpack(given["vec"], index.dtype).astype(np.float64)
        qid, cid, bound = asked["vec_id"].to_numpy(), given["vec_id"].to_numpy(), asked["bound"].to_numpy().copy()
        # the first candidates of the block tighten the bounds for the others
        head = 4 * (index.k + 1)
        if len(c) > head:
            bound = np.maximum(bound, np.partition(q @ c[:head].T, -(index.k + 1), axis=1)[:, -(index.k + 1)] - 1e-9 * (1 + index.length2))
        for at in range(0, len(q), 256):
            rows, cols = scan(q[at : at + 256], c, bound[at : at + 256], index)
            rows = rows + at
            other = qid[rows] != cid[cols]
            rows, cols = rows[other], cols[other]
            score = np.concatenate([(q[rows[i : i + 65536]] * c[cols[i : i + 65536]]).sum(1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
            order = np.lexsort((cid[cols], -score, rows))
            rows, cols, score = rows[order], cols[order], score[order]
            new = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, dtype=bool)
            place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            on = place < index.k
            out["query_id"].append(qid[rows[on]])
            out["vec_id"].append(cid[cols[on]])
            out["score"].append(score[on])
    return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})


def search(vectors: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    vectors, queries: vec_id, embedding; other columns are not read.  Vectors meet those of their own length.
    """
    candidates, asked, found = one_each(usable(vectors)), one_each(usable(queries)), None
    for some, d, _ in by_length(candidates):
        own = asked.where(F.size("embedding") == d)
        scale = scale_of(some.unionByName(own)) if as_numpy(some) is np.float64 else 1.0
        if scale != 1.0:
            some, own = (x.withColumn("embedding", F.transform("embedding", lambda c: c * scale)) for x in (some, own))
        made = search_usable(some, own, k, recall)
        if scale != 1.0:
            made = made.withColumn("score", F.col("score") / scale / scale)
        found = made if found is None else found.unionByName(made)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def scale_of(vectors: DataFrame) -> float:
    """A power of two that brings the largest component near 1 if squares of components could overflow or vanish; else 1."""
    peak = vectors.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    if not peak or SAFE[0] < peak < SAFE[1]:
        return 1.0
    return float(2.0 ** -np.clip(np.floor(np.log2(peak)), -1022, 1022))


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def in_lists(asked: DataFrame, vectors: DataFrame, index: Index) -> DataFrame:
    """(query_id, vec_id, score): the best of each block of the lists that are asked."""
    spark = vectors.sparkSession
    made = spark.sparkContext.broadcast(index)
    per_list = asked.groupBy("list").count().collect()  # at most MOST_LISTS
    rows = [(int(r["list"]), int(index.blocks[r["list"]]), -(-r["count"] // QUERY_ROWS)) for r in per_list if index.blocks[r["list"]]]
    dealt = spark.createDataFrame(rows, "list int, blocks int, asks int")
    candidates = listed(vectors, index).join(dealt, "list").select(
        "list", "block", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "vec_id", "vec", F.lit(None).cast("double").alias("bound")
    )
    asked = asked.join(dealt, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), F.col("asks")).cast("int").alias("ask"), "vec_id", "vec", "bound"
    )
    return candidates.unionByName(asked).groupBy("list", "block", "ask").applyInPandas(lambda g: within(g, made.value), "query_id long, vec_id long, score double")


def search_usable(vectors: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> DataFrame:
    """search() of vectors that all take part.

    The nearest lists are scanned first; a query's k-th best there bounds the scan of its other lists, so what
    a query returns does not grow with the lists.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    index = build(vectors, k, recall)
    asked = probing(queries, index)
    near = -(-index.probes // FIRST_LISTS)
    first = cut(ranked(in_lists(asked.where(F.col("nth") < near), vectors, index), k))
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    rest = asked.where(F.col("nth") >= near).join(reached, "vec_id", "left")
    rest = rest.withColumn("bound", F.greatest("bound", F.coalesce("kth", "bound"))).drop("kth")
    found = first.select("query_id", "vec_id", "score").unionByName(in_lists(rest, vectors, index))
    found = cut(ranked(found, k).select("query_id", "rank", "vec_id", "score"))
    # a query that the test left with too few is compared with all rows
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, int(index.sizes.sum()) - 1))
    short = cut(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"))
    if short.isEmpty():
        return found
    exact = ranked(in_lists(probing(short, index, every=True), vectors, index), k).select(*found.columns)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*found.columns).unionByName(exact)


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)
