"""Streaming: variants that arrive as files are given features or scores by the same plans as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

VARIANT_SCHEMA = "variant_id long, chromosome int, ref_allele string, alt_allele string, flank_1 string, flank_2 string, clinical_significance string"


def variant_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Variants of the parquet files that appear in a folder."""
    return spark.readStream.schema(VARIANT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_table(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write what a stateless plan makes of the stream; ends when the files that are there are done."""
    return plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
