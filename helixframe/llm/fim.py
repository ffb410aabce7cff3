"""Fill-in-middle: a text's prefix, middle and suffix, cut at token boundaries and put in a new order.

A token is a run of ASCII letters or any other single code point.  Every code point has a class: a letter inside
its run, a run's last letter, white space, anything else.  A wavelet matrix over the classes of a slice of texts
answers how many of a class stand before a place; such ranks, added over the classes that end a token, count the
boundaries before a place, and bisection on that count finds the place of both cuts.  All texts of a slice are
bisected together.

Nulls count as empty texts, which stay plain, as do texts that hold a sentinel.  Null ids are hashed as the empty
text.  Repeated rows give repeated, equal rows; other columns of docs are not read, so their names cannot clash; an
empty table gives an empty one.  Texts of any length are cut whole: a slice holds up to a number of bytes, and a longer
text is a slice of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, per_batch, small_batches, table

#: Classes of code points, and the ones that end a token.
INNER, LAST, SPACE, OTHER = range(4)
TOKEN = (LAST, SPACE, OTHER)
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of texts that stay plain, and of the rest that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


class Bits:
    """A packed bit vector with the number of ones before each of its words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks over a sequence of small numbers: a bit vector for each bit, from the highest; each level puts zeros first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in reversed(range(bits)):
            bit = (symbols >> b & 1).astype(bool)
            self.levels.append((Bits(bit), len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols are this one."""
        start, end = np.zeros(1, dtype=np.int64), np.asarray(i, dtype=np.int64)
        for b, (vector, zeros) in zip(reversed(range(self.bits)), self.levels):
            if symbol >> b & 1:
                start, end = zeros + vector.rank(start), zeros + vector.rank(end)
            else:
                start, end = start - vector.rank(start), end - vector.rank(end)
        return end - start

    def locate(self, symbols: tuple[int, ...], start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The first place from start on before which, from start, there are k of the symbols; end if there are fewer."""
        count = lambda i: sum(self.rank(s, i) for s in symbols)
        low, high, wanted = start.copy(), end.copy(), count(start) + k
        while (low < high).any():
            middle = (low + high) >> 1
            enough = count(middle) >= wanted
            low, high = np.where(enough | (low >= high), low, middle + 1), np.where(enough, middle, high)
        return low


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(class of every code point of the texts in a row, where each text begins and the last ends)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, texts)])
    letter = ((points | 32) >= ord("a")) & ((points | 32) <= ord("z"))
    goes_on = np.zeros(len(points), dtype=bool)
    goes_on[:-1] = letter[:-1] & letter[1:]
    goes_on[ends[1:][ends[1:] > 0] - 1] = False
    space = (points == 32) | (points >= 9) & (points <= 13)
    return np.where(letter, np.where(goes_on, INNER, LAST), np.where(space, SPACE, OTHER)).astype(np.uint8), ends


def dice(ids: list, seed: int) -> np.ndarray:
    """Four whole numbers of 32 bits for each id, from a digest of the seed and the id."""
    digest = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digest, dtype=">u4").astype(np.int64).reshape(-1, 4)


def cuts(texts: list[str], rolls: np.ndarray, ends_token: tuple[int, ...] = TOKEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, code points before the first cut, code points before the second) of each text."""
    symbols, ends = classes(texts)
    matrix = WaveletMatrix(symbols, 2)
    total = sum(matrix.rank(s, ends) for s in ends_token)
    n = np.diff(total)
    drawn = np.sort(rolls[:, :2] % (n + 1)[:, None], axis=1)
    start, end = np.tile(ends[:-1], 2), np.tile(ends[1:], 2)
    at = matrix.locate(ends_token, start, end, drawn.T.ravel()) - start
    return n, at[: len(texts)], at[len(texts) :]


def arrange(text: str, a: int, b: int, form: str) -> str:
    """The text in its form, cut before code points a and b."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(output: str, form: str) -> str:
    """The text that an output of a form was made of.

    No sentinel overlaps another one, and none stands in a text that is not plain, so the first of each is the one put there.
    """
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def formed(ids: list, texts: list[str], seed: int, plain: int, suffix_first: int) -> dict[str, list]:
    """Columns n, form, prefix_chars, middle_chars and output of a slice of texts."""
    rolls = dice(ids, seed)
    n, first, second = (x.tolist() for x in cuts(texts, rolls))
    forms, outputs = [], []
    for t, a, b, (_, _, h3, h4) in zip(texts, first, second, rolls.tolist()):
        stays = not t or h3 % 100 >= 100 - plain or any(s in t for s in SENTINELS)
        forms.append("plain" if stays else "spm" if h4 % 100 < suffix_first else "psm")
        outputs.append(arrange(t, a, b, forms[-1]))
    shown = [f != "plain" for f in forms]
    return {
        "n": n, "form": forms, "prefix_chars": [a if s else None for s, a in zip(shown, first)],
        "middle_chars": [b - a if s else None for s, a, b in zip(shown, first, second)], "output": outputs,
    }


def by_slices(docs: DataFrame, made, schema: str) -> DataFrame:
    """Apply made(ids, texts), which gives columns, to slices of (doc_id, text) of bounded bytes."""
    small_batches(docs.sparkSession)

    def rows(batch: dict[str, pa.Array]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["doc_id"].to_pylist()}
        for a, b in byte_slices(batch["text"]):
            texts = [t or "" for t in batch["text"][a:b].to_pylist()]
            for name, values in made(out["doc_id"][a:b], texts).items():
                out.setdefault(name, []).extend(values)
        return out

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), rows, f"doc_id long, {schema}")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document; docs: doc_id, text.

    plain: percent of texts that stay as they are; suffix_first: percent of the others whose suffix comes first.
    Each document is cut where it is read; nothing is shuffled.
    """
    schema = "n long, form string, prefix_chars long, middle_chars long, output string"
    return by_slices(docs, lambda ids, texts: formed(ids, texts, seed, plain, suffix_first), schema)


def digests(docs: DataFrame, seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """fill_in_middle with digests for outputs and for the texts rebuilt from them."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def made(ids: list, texts: list[str]) -> dict[str, list]:
        out = formed(ids, texts, seed, plain, suffix_first)
        outputs = out.pop("output")
        return out | {"output_sha256": list(map(sha, outputs)), "restored_sha256": [sha(restore(o, f)) for o, f in zip(outputs, out["form"])]}

    return by_slices(docs, made, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def _roll(i: int) -> str:
    return f"('0x' || substr(digest, {8 * i + 1}, 8))::UBIGINT"


ORACLE = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
r AS (SELECT doc_id, text, tokens, len(tokens) AS n, {", ".join(f"{_roll(i)} AS h{i + 1}" for i in range(4))} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b FROM r),
p AS (
  SELECT doc_id, text, n, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
