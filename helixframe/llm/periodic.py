"""Periodic runs of words: stretches that repeat a period at least four times, found over a suffix array.

The suffixes of a text's words are sorted by prefix doubling, for all texts of a slice at once.  Neighbours in that
order are the edges of a forest, weighted by their longest common prefix (LCP); edges are taken by decreasing LCP and
unite classes of suffixes by union-find, as Kruskal's algorithm does.  A class keeps its positions in order.  Two
positions that a union makes neighbours have exactly the edge's LCP in common; if they are no farther apart than that,
the stretch from the first to the end of what is common repeats with their distance as its period.  It is the smallest
period, as any smaller one would have put another position of the class between them.

A run has a smallest period q and at least 6 and 4 q words, so the LCP of its seed is at least 5 and 3 q: edges below
5 cannot seed one and are left out.

Nulls count as texts without words; a text without runs has null fields for its longest one.  Null ids are hashed as the empty
text.  Repeated rows give repeated, equal rows; other columns of docs are not read, so their names cannot clash; an
empty table gives an empty one.  Texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, per_batch, small_batches, table

#: A run repeats its period so many times and has so many words at least; so the LCP of a seed is at least LEAST_LCP.
TIMES, WORDS = 4, 6
LEAST_LCP = 5
#: Positions in a block of an ordered set before it is halved.
BLOCK = 2048

Run = tuple[int, int, int]  # start, length, period


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a periodic tail in one of ten documents, by a hash of the id."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, in the order of first occurrence over the slice; where each text begins and the last ends)."""
    numbers: dict[bytes, int] = {}
    made = [numbers.setdefault(w, len(numbers)) for words in texts for w in words]
    return np.array(made, dtype=np.int64), np.cumsum([0, *map(len, texts)])


def suffix_order(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, slots whose suffixes share 4 words with another one's, their groups) of texts in a row.

    Suffixes of different texts share nothing.  A suffix's rank is the slot where its group of equal prefixes begins;
    a round doubles the length of the prefixes, and only groups of more than one suffix are sorted again.
    """
    n = len(words)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    end = ends[1:][text]
    first = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    live = np.arange(n)
    close = groups = np.zeros(0, dtype=np.int64)
    length, keys, at = 1, first[order], order
    while len(live):
        head = np.ones(len(live), dtype=bool)
        head[1:] = keys[1:] != keys[:-1]
        order[live] = at
        rank[at] = live[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))]
        alone = head & np.append(head[1:], True)
        live = live[~alone]
        at = order[live]
        if length == 4:
            close, groups = live, rank[at]
        ahead = at + length
        after = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1)
        keys = rank[at] * (n + 1) + after + 1
        again = np.argsort(keys, kind="stable")
        keys, at = keys[again], at[again]
        length *= 2
    return order, close, groups


def edges(words: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(suffix, its neighbour before it in suffix order, their LCP) of all with an LCP of at least LEAST_LCP, by decreasing LCP."""
    order, close, groups = suffix_order(words, ends)
    pair = (close[1:] == close[:-1] + 1) & (groups[1:] == groups[:-1])
    after, before = order[close[1:][pair]], order[close[:-1][pair]]
    by_place = np.argsort(after)
    after, before = after[by_place], before[by_place]
    last = ends[1:][np.searchsorted(ends[1:], after, side="right")]
    room = last - np.maximum(after, before)
    told, lcp, h, previous = words.tolist(), [], 0, -2
    for i, j, most in zip(after.tolist(), before.tolist(), room.tolist()):
        # the LCP falls by one at most from a suffix to the next one
        h = h - 1 if i == previous + 1 and h else 0
        while h < most and told[i + h] == told[j + h]:
            h += 1
        lcp.append(h)
        previous = i
    common = np.array(lcp, dtype=np.int64)
    by_lcp = np.argsort(-common, kind="stable")
    by_lcp = by_lcp[common[by_lcp] >= LEAST_LCP]
    return after[by_lcp].tolist(), before[by_lcp].tolist(), common[by_lcp].tolist()


def around(blocks: list[list[int]], x: int) -> tuple[int, int]:
    """The positions before and after x in an ordered set of blocks that lacks x; -1 where there is none."""
    k = bisect_right(blocks, x, key=lambda b: b[0]) - 1 if len(blocks) > 1 else 0
    if k < 0:
        return -1, blocks[0][0]
    block = blocks[k]
    i = bisect_right(block, x)
    after = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
    return block[i - 1] if i else -1, after


def insert(blocks: list[list[int]], x: int) -> None:
    k = max(bisect_right(blocks, x, key=lambda b: b[0]) - 1, 0) if len(blocks) > 1 else 0
    block = blocks[k]
    insort(block, x)
    if len(block) > BLOCK:
        blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]


def seeds(after: list[int], before: list[int], lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(position, next position of its class, LCP) of every pair that a union makes neighbours."""
    root: dict[int, int] = {}
    members: dict[int, list[list[int]]] = {}
    sizes: dict[int, int] = {}

    def find(x: int) -> int:
        top = root.setdefault(x, x)
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for i, j, common in zip(after, before, lcp):
        a, b = find(i), find(j)
        if sizes.get(a, 1) < sizes.get(b, 1):
            a, b = b, a
        large, small = members.get(a) or [[a]], members.pop(b, None) or [[b]]
        added = [x for block in small for x in block]
        for k, x in enumerate(added):
            left, right = around(large, x)
            # neighbours after the union: no other one of the smaller class is between
            if left >= 0 and (not k or added[k - 1] < left):
                yield left, x, common
            if right >= 0 and (k + 1 == len(added) or added[k + 1] > right):
                yield x, right, common
        for x in added:
            insert(large, x)
        members[a], root[b] = large, a
        sizes[a] = sizes.get(a, 1) + sizes.pop(b, 1)


def runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, as (start, length, period), by start, then period."""
    words, ends = numbered(texts)
    found: list[list[Run]] = [[] for _ in texts]
    starts = ends.tolist()
    told = words.tolist()
    for i, j, common in seeds(*edges(words, ends)):
        period = j - i
        if common >= (TIMES - 1) * period and common + period >= WORDS:
            t = bisect_right(starts, i) - 1
            # a pair that goes on to the left is part of the run of the pair before it
            if i == starts[t] or told[i - 1] != told[j - 1]:
                found[t].append((i - starts[t], common + period, period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in found):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def longest(found: list[Run]) -> Run | None:
    return min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)


def by_slices(docs: DataFrame, made, schema: str) -> DataFrame:
    """Apply made(words, runs) of a text, which gives a row, to (doc_id, text), in slices of bounded bytes."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *[f.split()[0] for f in schema.split(", ")]]

    def rows(batch: dict[str, pa.Array]) -> dict[str, list]:
        out = []
        ids, data = batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())
        for a, b in byte_slices(data):
            # bytes are split at ASCII white space only
            texts = [planted((t or b"").split(), i) for i, t in zip(ids[a:b], data[a:b].to_pylist())]
            out += [(i, *made(words, found)) for i, words, found in zip(ids[a:b], texts, runs(texts))]
        return dict(zip(names, map(list, zip(*out))))

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), rows, f"doc_id long, {schema}")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of each document: its runs and its words without the repeats.  docs: doc_id, text.

    Each document is searched where it is read; nothing is shuffled.
    """

    def made(words: list[bytes], found: list[Run]):
        return [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(collapsed(words, found)).decode()

    return by_slices(docs, made, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digests(docs: DataFrame) -> DataFrame:
    """The longest run of each document, their number, and digests of all runs and of the collapsed text."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def made(words: list[bytes], found: list[Run]):
        start, length, period = longest(found) or (None, None, None)
        milli = None if period is None else 1000 * length // period
        told = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        return len(found), start, length, period, milli, sha(told), sha(b" ".join(collapsed(words, found)))

    return by_slices(docs, made, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


# crc32 of the id's digits, bit by bit: a first step of each byte mixes it in, eight more shift the remainder
_CRC = """xor(list_reduce(
  list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(digits) + 1), lambda k:
    list_prepend((ascii(substr(digits, k::INT, 1)) + 1099511627776)::UBIGINT, list_transform(range(8), lambda z: 0::UBIGINT))))),
  lambda acc, x: CASE WHEN x > 0 THEN xor(acc, x - 1099511627776::UBIGINT) ELSE xor(acc >> 1, (acc & 1) * 3988292384::UBIGINT) END), 4294967295::UBIGINT)"""
#: Places whose next 5 words are equal, by distance; consecutive ones are one stretch, of which the smallest distance counts.
ORACLE = f"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, '') AS digits, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w0
  FROM documents),
h AS (SELECT doc_id, rid, w0, len(w0) AS n, {_CRC}::BIGINT AS h FROM t),
p AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM h),
w AS (
  SELECT doc_id, rid, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w0[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)::INT]) ELSE w0 END AS words
  FROM p),
e AS (SELECT rid, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda i: array_to_string(words[(i + 1)::INT:(i + 5)::INT], ' '))) AS five FROM w WHERE n >= 6),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS d FROM e x JOIN e y ON x.rid = y.rid AND x.five = y.five AND y.i > x.i AND y.i - x.i <= x.n // 4),
marked AS (SELECT rid, i, d, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS island FROM pairs),
stretches AS (SELECT rid, d, min(i) AS start, count(*) + 4 + d AS length FROM marked GROUP BY rid, d, island),
runs AS (SELECT rid, start, length, min(d) AS period FROM stretches WHERE length >= greatest(6, 4 * d) GROUP BY rid, start, length),
per AS (
  SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, q := period), (-length, start, period)) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT rid, unnest(words) AS word, unnest(range(n)) AS i FROM w) ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.l // top.q)::BIGINT AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)
"""
