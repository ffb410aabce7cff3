"""BPE encoding and decoding with a word-level vocabulary that marks word ends.

Encoding runs a priority queue of merge ranks over a doubly linked list of symbols; entries whose symbols
have changed since they were queued are stale and skipped.  Decoding joins vocabulary strings.

Nulls count as empty texts; an empty text has no ids.  Texts of any length are encoded whole.
Of equal ranks the leftmost pair is merged first.  Only doc_id and text are read, so names of other columns cannot clash;
repeated rows give repeated, equal rows, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, small_batches, table

#: Words in a generation of a worker's cache, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: A queue entry is one number: the rank, then the place in the word; a pair's is its left id, then its right one.
PLACE, WIDE = 40, 1 << 24
PLACES = (1 << PLACE) - 1

# Fixed values of the vocabulary file's pre-tokenizer; white space as Unicode defines it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load(path: str | None = None) -> dict:
    """Vocabulary, ranks of merges and special tokens from a tokenizer file."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"vocab": model["vocab"], "merges": merges, "end": model.get("end_of_word_suffix") or "", "special": special}


class WordBpe(dict):
    """Encoder and decoder of one vocabulary.

    The mapping itself is a cache from words to ids in two generations: when the young one is full it becomes
    the old one, and words that are asked for again move back.  So memory is bounded and frequent words stay.
    """

    def __init__(self, spec: dict):
        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}
        vocab, end = spec["vocab"], spec["end"]
        self.special = spec["special"]
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.decimals = {i: str(i) for i in self.strings}
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + end] for c in chars]
        # a pair of ids is one number; its merge's rank, and for each rank the pair and the id it makes
        self.ranks: dict[int, int] = {}
        self.pairs, self.made = [], []
        for left, right in spec["merges"]:
            pair = vocab[left] * WIDE + vocab[right]
            self.ranks.setdefault(pair, len(self.pairs))
            self.pairs.append(pair)
            self.made.append(vocab[left + right])
        self.find = regex.compile(WORDS).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word) or self.merge(word.encode())
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: merges by rank, the leftmost first, from a queue over a doubly linked list."""
        n = len(word)
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if n == 1:
            return tuple(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of, pairs, made = self.ranks.get, self.pairs, self.made
        queue = [r << PLACE | i for i in range(n - 1) if (r := rank_of(ids[i] * WIDE + ids[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            r, i = entry >> PLACE, entry & PLACES
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] * WIDE + ids[j] != pairs[r]:
                continue  # stale: one of the two was merged meanwhile
            ids[i] = whole = made[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(whole * WIDE + ids[k])) is not None:
                    push(queue, r << PLACE | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] * WIDE + whole)) is not None:
                push(queue, r << PLACE | h)
        return tuple([x for x in ids if x >= 0])

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            # lower case character by character, so without the final form of sigma
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return self.find(text.lower())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.__getitem__, self.words(text))))
        out: list[int] = []
        for part in self.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(self.__getitem__, self.words(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, joined by spaces as a tokenizer without a decoder does."""
        return " ".join(map(self.strings.__getitem__, ids))


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of each document.  docs: doc_id, text; other columns are not read.

    The vocabulary (a few MB, whatever the input) is broadcast; each document is encoded where it is read.
    """
    small_batches(docs.sparkSession)
    made = docs.sparkSession.sparkContext.broadcast(load(path))

    def rows(batch: dict) -> dict:
        bpe = worker(made)
        ids = [bpe.encode(t) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "ids": ids, "decoded": list(map(bpe.decode, ids))}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what with_tokens makes, as digests of whole documents."""
    small_batches(docs.sparkSession)
    made = docs.sparkSession.sparkContext.broadcast(load(path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def rows(batch: dict) -> dict:
        bpe = worker(made)
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch["text"]:
            ids = bpe.encode(text.as_py())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha(" ".join(map(bpe.decimals.__getitem__, ids))))
            out["decoded_sha256"].append(sha(bpe.decode(ids)))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


_BUILT: dict[int, WordBpe] = {}


def worker(made) -> WordBpe:
    """The worker's encoder, built once for each broadcast vocabulary."""
    spec = made.value
    if id(spec) not in _BUILT:
        _BUILT.clear()
        _BUILT[id(spec)] = WordBpe(spec)
    return _BUILT[id(spec)]


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
