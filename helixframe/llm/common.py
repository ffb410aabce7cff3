"""What the operators share: tables, shared folders, Arrow batches and components of links."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts can be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 512
#: Bytes of text that a function handles at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_of(key: Column, seed: int, share: Column | float) -> Column:
    """Whether the key's hash falls into a share of all hashes; exact to 2^-52, so no share above zero becomes none."""
    place = F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    return place.cast("double") < (share if isinstance(share, Column) else F.lit(share)) * float(1 << 62)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as make it none of those taken (in any case of letters)."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts can hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with up to so many bytes of text each; a longer text is a range of its own."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(texts):
        yield start, len(texts)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))  # one machine, as in tests
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    It acts when the driver collects its garbage, which between large steps may otherwise not happen for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def per_batch(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply a function from columns to columns to every Arrow batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = rows({n: b.column(i) for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each linked id.

    links: columns a, b (long), a != b.  Returns (id, component_id) for every id in a link.
    Alternating star contraction: every round moves each id's larger neighbours to its smallest one, then
    each id's smaller neighbours likewise.  The rows never exceed the links, no id's neighbours are
    gathered in one task (only minima are aggregated), and a round's result is checkpointed.
    """
    edges = cut(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        # large star: neighbours above u go to the smallest of u and its neighbours
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        )
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        # small star: neighbours below u, and u itself, go to the smallest of them
        small = large.join(low, "u")
        edges = cut(
            small.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.select("u", F.col("low").alias("v")))
            .where("u != v")
            .distinct()
        )
        # a forest of stars is stable: no id is both a leaf and a centre
        n = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (n["n"], n["h"]) == total:
            break
        total = (n["n"], n["h"])
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return leaves.unionByName(leaves.select(F.col("component_id").alias("id"), "component_id").distinct())
