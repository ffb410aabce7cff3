"""Token counts of whole texts by the public tokenizers' libraries, without the tokens.

Texts are read as UTF-8 from Arrow batches and split at safe boundaries, ones that no token, no normalisation and no
special string can cross; pieces of many texts are then gathered into batches of about equal bytes, and a batch is
encoded by the library for its lengths only.  A piece is short, so pieces come again and again: a bounded cache keeps
the counts of short ones, and a batch holds each missing piece once.

Which boundaries are safe depends on the vocabulary.  One whose pre-tokenizer drops white space (word_bpe) can be split
at every run of ASCII white space.  In others white space belongs to tokens, so whole texts go to the library.

Nulls count as empty texts, with no bytes and no tokens.  Special strings inside texts are handled as the library does
by default.  Repeated rows give repeated, equal rows; other columns of docs are not read, so their names cannot clash;
an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, byte_slices, per_batch, small_batches, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of pieces that the library encodes at once; a longer piece is a batch of its own.
BATCH_BYTES = 1 << 18
#: Pieces in a generation of a worker's cache, and the longest that is kept, in bytes.
CACHE_PIECES, CACHE_BYTES = 300_000, 64


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library_lengths(data: bytes, name: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(lengths of the encodings of texts, whether texts may be split at white space) for a tokenizer file."""
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], False
    import tokenizers

    spec = json.loads(data)
    made = tokenizers.Tokenizer.from_str(data.decode())
    made.no_truncation()
    made.no_padding()
    return lambda texts: [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)], drops_white_space(spec)


def drops_white_space(spec: dict) -> bool:
    """Whether no token of a tokenizer file's can hold or border on ASCII white space.

    So it is if the normalizer works on single characters or turns runs of white space into one space, if the first
    pre-tokenizer keeps matches of classes without white space only, and if no special string holds white space or
    strips what is around it.
    """
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    first = next(iter((spec.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    pattern = first.get("pattern", {}).get("Regex", " ")
    alone = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in spec["added_tokens"])
    return bool(steps) and plain and kept and alone and not any(map(str.isspace, pattern)) and r"\s" not in pattern.replace(r"[^\s", "[^")


class Counter(dict):
    """Counts of pieces: a cache in two generations, filled in batches by the library.

    When the young generation is full it becomes the old one, and pieces that are asked for again move back.
    """

    def __init__(self, lengths: Callable[[list[str]], list[int]], splits: bool):
        super().__init__()
        self.lengths, self.splits, self.old = lengths, splits, {}

    def encode(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        """Counts of pieces, in batches of bounded bytes; the longest first, so that equal lengths meet."""
        for batch in byte_batches(sorted(pieces, key=len, reverse=True)):
            yield from zip(batch, self.lengths([p.decode() for p in batch]))

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.splits:
            made = dict(self.encode(set(texts)))
            return [made[t] for t in texts]
        split = [t.split() for t in texts]  # bytes are split at ASCII white space only
        asked = set().union(*split)
        if len(self) + len(asked) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        missing, old = [], self.old
        for p in asked.difference(self):
            if (n := old.get(p)) is None:
                missing.append(p)
            else:
                self[p] = n
        long: dict[bytes, int] = {}
        for p, n in self.encode(missing):
            (self if len(p) <= CACHE_BYTES else long)[p] = n
        if not long:
            return [sum(map(self.__getitem__, words)) for words in split]
        known = {p: self[p] for p in asked if p in self} | long
        return [sum(map(known.__getitem__, words)) for words in split]


def byte_batches(pieces: Iterable[bytes], most: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    held, batch = 0, []
    for p in pieces:
        if batch and held + len(p) > most:
            yield batch
            held, batch = 0, []
        batch.append(p)
        held += len(p)
    if batch:
        yield batch


WHITE = b" \t\n\v\f\r"


def blocks(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A long text in blocks that end at white space; a block without any grows to the next one."""
    start = 0
    while len(text) - start > most:
        end = max(text.rfind(w, start, start + most) for w in map(bytes, zip(WHITE)))
        if end <= start:
            found = [e for w in map(bytes, zip(WHITE)) if (e := text.find(w, start + most)) >= 0]
            end = min(found, default=len(text))
        yield text[start:end]
        start = end
    if start < len(text):
        yield text[start:]


def count_slice(counter: Counter, texts: list[bytes]) -> list[int]:
    """Tokens of each text of a slice; a slice of one long text is counted block by block."""
    if counter.splits and len(texts) == 1:
        return [sum(counter.counts([b])[0] for b in blocks(texts[0]))]
    return counter.counts(texts)


def token_counts(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document; docs: doc_id, text.

    name: a file of the public tokenizers, .json or .model; path: a file to use instead of it.  The file (a few MB) is
    broadcast; each document is counted where it is read, nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    with open(path or path_of(name), "rb") as f:
        made = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = path or name

    def rows(batch: dict[str, pa.Array]) -> dict[str, list]:
        counter = worker(made, kind)
        data = batch["text"].cast(pa.binary())
        texts = lambda a, b: [t or b"" for t in data[a:b].to_pylist()]
        n = [x for a, b in byte_slices(data) for x in count_slice(counter, texts(a, b))]
        return {"doc_id": batch["doc_id"], "n_tokens": n, "n_bytes": batch["n_bytes"], "over_limit": [x > limit for x in n]}

    text = F.coalesce("text", F.lit(""))
    return per_batch(
        docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")),
        rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )


_BUILT: dict[int, Counter] = {}


def worker(made, kind: str) -> Counter:
    """The worker's counter, built once for each broadcast file."""
    data = made.value
    if id(data) not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _BUILT.clear()
        _BUILT[id(data)] = Counter(*library_lengths(data, kind))
    return _BUILT[id(data)]


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
