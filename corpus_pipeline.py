"""The corpus pipeline: documents in, token digests of the mixed corpus out.

Every stage takes columns of any number and name besides those of documents and hands them on as they are; texts of any
length are read whole; an empty table gives an empty one.  What becomes of nulls, ties and repeats stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, langid, mixing, secrets, simhash
from helixframe.llm.common import table

#: A document stays if its leading language holds this share of its words at least.  The stage is there to drop what is no
#: text in a known language; documents that mix two or even three languages are clean and stay.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those with letters and a leading language.

    Null and empty texts go; rows that repeat a doc_id are judged one by one; null langs teach nothing.
    """
    return langid.keep_identified(docs, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Null ids come last; of rows that repeat the id one stays (see simhash.drop_near_duplicates).
    """
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, n_chars counted anew; null texts stay null, repeats stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them.

    Null and empty texts have no tokens and go; null langs and sources are empty names; rows that repeat a doc_id are ordered together.
    """
    return mixing.mix(docs, mixing.domain_of(F.col("source")), mixing.RECIPE, epoch=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document; a null text counts as empty, each repeat has its row."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("bpe", encode),
]
#: Learned models and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
