"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints that differ in at most three of 64 bits agree in whole blocks of bits whichever way the bits are cut
into more than three blocks, so each distinct fingerprint goes to one group for every choice of agreeing blocks.
Within a task the fingerprints of each group are sorted by their rank in Gray order, runs of neighbours become
nodes that keep the bits all their members share, and pairs of nodes are followed from the top down: a pair
whose shared bits already differ too often is pruned whole, one whose members can't differ too often is linked
whole, and only what is left is compared fingerprint by fingerprint.  A task returns a forest, not all pairs.

Null and empty texts, and texts of white space, have fingerprint zero, which links like any other.  Equal
fingerprints are one node.  Rows that repeat a doc_id are the same document.  A null doc_id keeps its
fingerprint, links as any other document, and has a component if a document with an id is in it, else null.
Doc ids are below 2^62.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, free_name, per_batch, small_batches, table

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 3
#: Members of a node of the index, rows of a group that is not split, pairs followed at once, rows of a task.
ARITY, LARGE_GROUP, PAIRS, TASK_ROWS = 8, 1024, 1 << 20, 400_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Nodes from here on stand for fingerprints without an id.
NAMELESS = 1 << 62


def fingerprint(text: bytes) -> int:
    """Majority bits of the hashes of a text's word shingles."""
    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        part = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long.  docs: doc_id, text; other columns are not read."""
    small_batches(docs.sparkSession)

    def rows(batch: dict) -> dict:
        made = [fingerprint(t.as_py() or b"") for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "fp": np.array(made, dtype=np.uint64).view(np.int64)}

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), rows, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of its run, element) of every element of the runs [start, start + size)."""
    run = np.repeat(np.arange(len(starts)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class GrayIndex:
    """Levels of nodes over fingerprints sorted by group and Gray rank; a node never spans two groups."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), groups))
        codes, group = codes[self.order], groups[self.order]
        both = either = codes
        # each level: bits that all members have, bits that any has, first child, number of children
        self.levels = [(both, either, np.arange(len(codes)), np.ones(len(codes), dtype=np.intp))]
        self.leaf_first = [np.arange(len(codes))]
        while len(group) and (group[1:] == group[:-1]).any():
            new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(new, np.diff(np.r_[new, len(group)]))
            start = np.flatnonzero(place % ARITY == 0)
            both, either = np.bitwise_and.reduceat(both, start), np.bitwise_or.reduceat(either, start)
            self.levels.append((both, either, start, np.diff(np.r_[start, len(group)])))
            self.leaf_first.append(self.leaf_first[-1][start])
            group = group[start]
        self.leaf_end = [np.r_[f[1:], len(codes)] for f in self.leaf_first]

    def links(self, distance: int = DISTANCE):
        """Yield (u, v), places of linked fingerprints in the given arrays: enough to reach all that are linked."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        work = [(top, roots, roots)]
        while work:
            level, a, b = work.pop()
            if len(a) > PAIRS:
                half = len(a) // 2
                work += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            both, either, start, size = self.levels[level]
            loose = (both[a] ^ either[a]) | (both[b] ^ either[b])  # bits that some members don't share
            least = np.bitwise_count((both[a] ^ both[b]) & ~loose)
            most = np.bitwise_count((both[a] ^ both[b]) | loose)
            near = most <= distance
            if near.any():  # every member of the one links with every member of the other
                first, end = self.leaf_first[level], self.leaf_end[level]
                for side in (a[near], b[near]):
                    run, leaf = spread(first[side], end[side] - first[side])
                    head = first[a[near]][run]
                    differ = head != leaf
                    yield self.order[head[differ]], self.order[leaf[differ]]
            if level:
                go = (least <= distance) & ~near
                a, b = a[go], b[go]
                pair, left = spread(start[a], size[a])
                pair2, right = spread(start[b][pair], size[b][pair])
                left = left[pair2]
                keep = (a[pair][pair2] != b[pair][pair2]) | (left <= right)
                if keep.any():
                    work.append((level - 1, left[keep], right[keep]))


def forest(n: int, links) -> np.ndarray:
    """Smallest place reachable from each of n places."""
    label = np.arange(n)
    for u, v in links:
        while True:
            low = np.minimum(label[u], label[v])
            if (label[u] == low).all() and (label[v] == low).all():
                break
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def block_keys(n: int) -> list[list[int]]:
    """Masks of the block choices to group by: more, and so finer ones, the more fingerprints there are."""
    blocks = next(b for b in range(DISTANCE + 1, 9) if b == 8 or n >> (BITS * (b - DISTANCE) // b) <= 64)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [_mask(edges, chosen) for chosen in combinations(range(blocks), blocks - DISTANCE)]


def _mask(edges: list[int], chosen: tuple[int, ...]) -> int:
    return sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def keyed(nodes: DataFrame, masks: list[int], column: str) -> DataFrame:
    """A row for each mask, with a key of the mask and the bits under it."""
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    return nodes.withColumn(column, F.explode(F.array(*keys)))


def grouped(nodes: DataFrame, n: int) -> DataFrame:
    """(task, fp, node): any two fingerprints within the distance meet in some task group.

    A group above LARGE_GROUP is keyed once more by blocks of its remaining bits.  Where even those are large,
    its rows are dealt over blocks and each pair of blocks becomes a group, so no group is ever unbounded.
    """
    masks = block_keys(n)
    first = keyed(nodes, masks, "task")
    large = cut(first.groupBy("task").count().where(F.col("count") > LARGE_GROUP).select("task"))
    if large.isEmpty():
        return first
    split = first.join(large, "task", "left_semi")
    # what is left of the bits is cut into one block more than may differ; blocks over all bits do as well
    edges = [BITS * i // (4 * (DISTANCE + 1)) for i in range(4 * (DISTANCE + 1) + 1)]
    finer = [_mask(edges, tuple(range(i, len(edges) - 1, DISTANCE + 1))) for i in range(DISTANCE + 1)]
    second = keyed(split, finer, "finer").withColumn("task", F.xxhash64("task", "finer")).drop("finer")
    sizes = cut(second.groupBy("task").count().where(F.col("count") > LARGE_GROUP))
    rest = first.join(large, "task", "left_anti")
    if sizes.isEmpty():
        return rest.unionByName(second)
    blocks = F.ceil(F.col("count") * 2 / LARGE_GROUP).cast("int")
    dealt = second.join(sizes, "task").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    third = pairs.select(F.xxhash64("task", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "fp", "node")
    return rest.unionByName(second.join(sizes, "task", "left_anti")).unionByName(third)


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between the nodes of near fingerprints, enough of them to connect all that are near.

    nodes: fp long (distinct), node long.
    """
    n = nodes.count()
    groups = grouped(nodes, n)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(block_keys(n)) // TASK_ROWS)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        code, group, node = (t[c].to_numpy() for c in ("fp", "task", "node"))
        distinct, place = np.unique(node, return_inverse=True)
        index = GrayIndex(group, code.view(np.uint64))
        label = forest(len(distinct), ((place[u], place[v]) for u, v in index.links()))
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(distinct[linked]), pa.array(distinct[label[linked]])], names=["a", "b"])

    return groups.select("task", "fp", "node").repartition(parts, "task").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs: the smallest doc_id reachable over near fingerprints."""
    prints = cut(fingerprints(docs))
    # a fingerprint that only null ids have is a node too, above all ids
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned("fp", 2)
    nodes = cut(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), nameless).alias("node"), F.count("*").alias("n")))
    # a doc_id with several fingerprints is one document: its nodes are linked
    several = prints.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("doc_id is not null and low < high").select("doc_id")
    same = prints.join(several, "doc_id").join(nodes.select("fp", "node"), "fp").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    found = components(near_links(nodes.select("fp", "node")).unionByName(same))
    named = nodes.join(found.withColumnRenamed("id", "node"), "node", "left")
    # only fingerprints that several rows share or that are linked need a look-up
    shared = named.where("n > 1 or component_id is not null").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    out = prints.join(shared, "fp", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "fp", F.when(component < NAMELESS, component).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, of the smallest doc_id; all columns stay as they are, whatever their names.

    A null doc_id stands behind all others, equal texts with null ids being one document.  Of rows that repeat a
    kept doc_id the one with the smallest text stays (null texts count as empty).
    """
    id_of = F.coalesce(docs["doc_id"].cast("long"), F.lit(NAMELESS - 1) - F.xxhash64(F.coalesce(docs["text"], F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)))
    key = free_name("_key", docs.columns)
    found = cut(near_components(docs.select(id_of.alias("doc_id"), docs["text"])))
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(gone, id_of == gone[key], "left_anti")
    again = cut(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    if again.isEmpty():
        return kept
    rows = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce(F.col("text"), F.lit(""))).alias("row")
    one = kept.join(again, id_of == again[key]).groupBy(key).agg(rows).select("row.*")
    return kept.join(again, id_of == again[key], "left_anti").unionByName(one)


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
