"""Genomes in plain FASTA files, read by byte ranges: an index of their records, and context that fetches what variants need.

A row of the index says where a record's first base is and how many bases and bytes a line has, so the byte of any
position is known.  It is found from the headers alone: splits of the files look for record marks, and a record's
length follows from where the next one begins.  Context is fetched by tasks that hold variants of neighbouring
positions, so each reads the stretches of the files around its variants and nothing else; the genome is not shuffled.

Lines of a record have one width, but for the last one.  Compressed files cannot be entered in the middle; for them
fasta.chunks and fasta.with_context read whole genomes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .variant_fasta import Split, VariantReader, after_mark

INDEX = "accession string, file string, mark long, first long, bases int, bytes int, size long"
#: Bytes of a split that is looked through for records; gap between wanted bytes that is read along; most bytes of one read.
SPLIT_BYTES, GAP, MOST = 64 << 20, 1 << 15, 8 << 20
#: Records of an index that is sent to all tasks; beyond it the index is joined by a shuffle.
SENT_RECORDS = 100_000


def headers(f, split: Split, size: int) -> Iterator[dict]:
    """An index row, but for the record's length, of each record whose mark is in a split.

    size: of the file as if it ended with one line end of the record's.
    """
    at = after_mark(f, split.start)
    f.seek(max(size - 64, 0))
    closed = size - len(tail) + len(tail.rstrip()) if (tail := f.read(64)) else 0
    while at is not None and at - 1 < min(split.end, size):
        f.seek(at)
        text = b""
        while text.count(b"\n") < 2 and (block := f.read(1 << 12)):
            text += block
        head, _, rest = text.partition(b"\n")
        line, newline, _ = rest.partition(b"\n")
        bases = len(line.rstrip(b"\r")) if not line.startswith(b">") else 0
        words, last = head.split(), max(closed, at + len(head) + 1)
        yield {
            "accession": words[0].decode() if words else "", "file": split.path, "mark": at - 1, "first": at + len(head) + 1,
            "bases": bases, "bytes": len(line) + len(newline) if bases else 1, "size": last + (len(line) - bases + len(newline) if bases else 0),
        }
        at = after_mark(f, at)


def genome_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(accession, file, first, bases, bytes, total) of every record of the files of a path.

    accession: the first word of the header; first: the byte of its first base; bases, bytes: of a line; total: the record's
    bases.  Two records of one accession are two rows.
    """
    reader = VariantReader({"path": path, "splitbytes": str(split_bytes)})
    splits = [(s.path, s.start, s.end) for s in reader.partitions() if s.path]
    if any(e is None for _, _, e in splits):
        raise ValueError("a compressed genome has no byte index")
    asked = spark.createDataFrame(splits, "path string, start long, end long").repartition(max(min(len(splits), spark.sparkContext.defaultParallelism * 8), 1))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = reader.system()
        for batch in batches:
            for s in batch.itertuples():
                size = store.get_file_info(s.path).size
                with store.open_input_file(s.path) as f:
                    yield pd.DataFrame(list(headers(f, Split(s.path, s.start, s.end), size)), columns=[c.split()[0] for c in INDEX.split(", ")])

    found = asked.mapInPandas(look, INDEX)
    end = F.coalesce(F.lead("mark").over(Window.partitionBy("file").orderBy("mark")), F.col("size"))
    span = F.greatest(end - F.col("first"), F.lit(0))
    lines = F.floor(span / F.col("bytes"))
    short = F.greatest(span - lines * F.col("bytes") - F.col("bytes") + F.col("bases"), F.lit(0))  # a last line, less its end
    return found.select("accession", "file", "first", "bases", "bytes", (lines * F.col("bases") + short).cast("long").alias("total"))


@dataclass
class Span:
    """Bytes [start, end) of a file, and what to cut from their bases."""

    start: int
    end: int
    row: int


def together(spans: list[Span]) -> Iterator[list[Span]]:
    """Spans in the order of their start, those that one read serves."""
    group: list[Span] = []
    end = 0
    for s in sorted(spans, key=lambda s: s.start):
        if group and (s.start > end + GAP or max(end, s.end) - group[0].start > MOST):
            yield group
            group, end = [], 0
        group.append(s)
        end = max(end, s.end)
    if group:
        yield group


def fetched(f, spans: list[Span]) -> Iterator[tuple[int, str]]:
    """(row, bases) of spans of a file."""
    for group in together(spans):
        start, end = group[0].start, max(s.end for s in group)
        f.seek(start)
        data = f.read(end - start)
        for s in group:
            yield s.row, b"".join(data[s.start - start : s.end - start].split()).decode().upper()


def with_context(variants: DataFrame, index: DataFrame, path: str, flank: int) -> DataFrame:
    """variants with flank_1, flank_2 and whether the genome has the reference allele, as fasta.with_context has them.

    variants: variant_id, accession, position (from 1), ref_allele and others, which stay; index: of genome_index for the
    same path, accessions once.  Variants of unknown accessions are left out.
    """
    few = index.limit(SENT_RECORDS + 1).count() <= SENT_RECORDS
    p, n, total = F.col("position"), F.length("ref_allele"), F.col("total")
    spans = variants.join(F.broadcast(index) if few else index, "accession").withColumns({
        "_s1": F.greatest(F.lit(1), p - flank), "_e1": F.greatest(F.greatest(F.lit(1), p - flank), p - 1),
        "_s2": F.least(total, p + n), "_e2": F.least(total, p + n + flank - 1),
    })
    spans = spans.withColumn("_e2", F.greatest("_e2", "_s2")).withColumn("_last", F.least(total, F.greatest("_e2", p + n - 1)))
    byte = lambda x: F.col("first") + F.floor((x - 1) / F.col("bases")) * F.col("bytes") + (x - 1) % F.col("bases")
    placed = spans.withColumns({"_from": byte(F.col("_s1")), "_to": byte(F.col("_last")) + 1})
    # tasks get neighbouring variants, so that their stretches overlap
    near = placed.repartitionByRange("file", "_from").sortWithinPartitions("file", "_from")
    reader = VariantReader({"path": path})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = reader.system()
        for batch in batches:
            bases = [""] * len(batch)
            for file, rows in batch.reset_index(drop=True).groupby("file"):
                with store.open_input_file(file) as f:
                    for i, text in fetched(f, [Span(a, b, i) for i, a, b in zip(rows.index, rows["_from"], rows["_to"])]):
                        bases[i] = text
            yield batch.assign(_text=bases)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema) + ", _text string"
    found = near.mapInPandas(read, schema)
    cut = lambda a, b: F.substr("_text", (a - F.col("_s1") + 1).cast("int"), (b - a + 1).cast("int"))
    out = found.withColumns({
        "flank_1": cut(F.col("_s1"), F.col("_e1")), "flank_2": cut(F.col("_s2"), F.col("_e2")),
        "ref_matches": cut(p, p + n - 1) == F.upper("ref_allele"),
    })
    return out.select(*variants.columns, "flank_1", "flank_2", "ref_matches")
