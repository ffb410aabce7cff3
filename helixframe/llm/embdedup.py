"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

All pairs of vectors are compared in tiles of two bounded blocks.  Unit vectors are quantised to int8 with a scale
each, codes that float32 carries so that the product of two blocks' codes is exact, and each vector's measured quantisation error bounds how far
the true cosine can be from the scaled product.  Only pairs whose bound reaches the threshold are computed again in
double precision from the original vectors, so no pair is lost and none below the threshold is linked.

Blocks follow the lists of a k-means fit on a bounded sample.  A pair of lists is skipped if the angle between
their centroids less both lists' radii leaves no room for a near pair.  A list of any size is cut
into bounded blocks, and a tile returns counts and a forest of its links, never its pairs.

Vectors of different lengths have no links with each other.  Vectors that take no part (see vectors.usable) have no links and are their own component.  Rows that repeat a
vec_id count as one vector, the smallest by component order; a null vec_id has no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, small_batches, table
from .simhash import forest
from .vectors import as_numpy, by_length, centroids, matrix, nearest, one_each, sample, unpack, usable

THRESHOLD = 0.9
#: Rows of a block, rows of a product computed at once, rows of a list on average, most lists.
BLOCK_ROWS, STRIP, LIST_ROWS, MOST_LISTS = 4096, 1024, 8192, 256
#: Components whose products of int8 codes a float32 sums exactly; longer vectors are summed piece by piece.
EXACT = 1000


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as float32 integers, scales, error norms) of unit rows."""
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None])
    error = np.linalg.norm(u - codes * scale[:, None], axis=1) + 1e-12
    return codes.astype(np.float32), scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes."""
    total = a[:, :EXACT] @ b[:, :EXACT].T
    for at in range(EXACT, a.shape[1], EXACT):
        total = total.astype(np.float64) + a[:, at : at + EXACT] @ b[:, at : at + EXACT].T
    return total


def near_pairs(u: np.ndarray, v: np.ndarray | None, threshold: float):
    """Yield (row, row) pairs of unit rows with cosine at least the threshold; v None: pairs within u, each once."""
    same = v is None
    v = u if same else v
    (cu, su, eu), (cv, sv, ev) = quantise(u), quantise(v)
    for i in range(0, len(u), STRIP):
        for j in range(i if same else 0, len(v), STRIP):
            a, b = slice(i, i + STRIP), slice(j, j + STRIP)
            # |u.v - scaled product| <= |e_u| |v| + |u - e_u| |e_v|
            # float32 carries the codes' sums exactly; its rounding from here on is within 1e-5
            scaled = products(cu[a], cv[b]).astype(np.float32, copy=False)
            scaled *= su[a, None].astype(np.float32)
            scaled *= sv[b].astype(np.float32)
            scaled += eu[a, None].astype(np.float32)
            r, c = np.nonzero(scaled >= (threshold - (1 + eu[a].max()) * ev[b] - 1e-5).astype(np.float32))
            if same and i == j:
                r, c = r[r < c], c[r < c]
            for k in range(0, len(r), 1 << 16):
                x, y = r[k : k + (1 << 16)] + i, c[k : k + (1 << 16)] + j
                near = (u[x] * v[y]).sum(1) >= threshold
                if near.any():
                    yield x[near], y[near]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile(group: pd.DataFrame, threshold: float, dtype: type) -> pd.DataFrame:
    """(vec_id, n, root): links of each linked vector in a tile of two blocks, and a vector it reaches."""
    first = group.iloc[0]
    left = (group["list"] == first["la"]) & (group["block"] == first["ba"])
    a, b = group[left], group[~left]
    ids = np.r_[a["vec_id"].to_numpy(), b["vec_id"].to_numpy()]
    u = unit(unpack(a["vec"], dtype)) if len(a) else None
    v = unit(unpack(b["vec"], dtype)) if len(b) else None
    own = (first["la"], first["ba"]) == (first["lb"], first["bb"])
    n = np.zeros(len(ids), dtype=np.int64)

    def found():
        if u is None or not own and v is None:
            return
        for x, y in near_pairs(u, None if own else v, threshold):
            y = y if own else y + len(u)
            np.add.at(n, x, 1)
            np.add.at(n, y, 1)
            yield x, y

    label = forest(len(ids), found())
    kept = np.flatnonzero(n)
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    return pd.DataFrame({"vec_id": ids[kept], "n": n[kept], "root": smallest[label[kept]]})


def blocks(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """(list, block, vec_id, vec, la, ba, lb, bb): each vector once for every tile that its block is in."""
    spark = vectors.sparkSession
    x = unit(sample(vectors, n))
    lists = centroids(x, int(np.clip(n // LIST_ROWS, 1, MOST_LISTS)))
    lists /= np.maximum(np.linalg.norm(lists, axis=1, keepdims=True), 1e-12)
    made = spark.sparkContext.broadcast(lists)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                u = unit(x)
                of = nearest(u, made.value)
                angle = np.arccos(np.clip((u * made.value[of]).sum(1), -1, 1))
                packed = pa.array([r.tobytes() for r in x])
                yield pa.RecordBatch.from_arrays([b.column(0), packed, pa.array(of.astype(np.int32)), pa.array(angle)], names=["vec_id", "vec", "list", "angle"])

    listed = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary, list int, angle double")
    seen = listed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # at most MOST_LISTS
    size = {r["list"]: -(-r["n"] // BLOCK_ROWS) for r in seen}
    radius = {r["list"]: r["radius"] for r in seen}
    apart = np.arccos(np.clip(lists @ lists.T, -1, 1))
    room = np.arccos(threshold) + 1e-6
    near = [(a, b, size[a], size[b]) for a in size for b in size if apart[a, b] - radius[a] - radius[b] <= room]
    partners = spark.createDataFrame(near or [(0, 0, 1, 1)], "list int, other int, n_blocks int, other_blocks int")
    dealt = listed.drop("angle").join(partners, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int"))
    dealt = dealt.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    here, there = F.struct("list", "block"), F.struct(F.col("other").alias("list"), F.col("other_block").alias("block"))
    low, high = F.least(here, there), F.greatest(here, there)
    return dealt.select("list", "block", "vec_id", "vec", low["list"].alias("la"), low["block"].alias("ba"), high["list"].alias("lb"), high["block"].alias("bb"))


def tiled(dealt: DataFrame, threshold: float, dtype: type) -> DataFrame:
    return dealt.groupBy("la", "ba", "lb", "bb").applyInPandas(lambda g: tile(g, threshold, dtype), "vec_id long, n long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.  vectors: vec_id, embedding; other columns are not read."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    one = one_each(vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding"))
    ids, lengths = one.select("vec_id"), by_length(usable(one))
    if not lengths:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None
    for ok, _, n in lengths:
        made = cut(tiled(blocks(ok, n, threshold), threshold, as_numpy(ok)))
        found = made if found is None else found.unionByName(made)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    reached = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    out = ids.join(counts.join(reached, "vec_id", "left"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op6_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
