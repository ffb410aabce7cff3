import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import tokencount

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def opened(name):
    with open(tokencount.path_of(name), "rb") as f:
        return f.read()


COUNTERS = {n: tokencount.Counter(*tokencount.library_lengths(opened(n), n)) for n in FILES}
WORD = tokenizers.Tokenizer.from_file(tokencount.path_of(FILES[0]))
BYTE = tokenizers.Tokenizer.from_file(tokencount.path_of(FILES[1]))
PIECE = sentencepiece.SentencePieceProcessor(model_file=tokencount.path_of(FILES[2]))
LIBRARY = {
    FILES[0]: lambda t: len(WORD.encode(t, add_special_tokens=False).ids), FILES[1]: lambda t: len(BYTE.encode(t, add_special_tokens=False).ids),
    FILES[2]: lambda t: len(PIECE.encode(t)),
}
HARD = [
    "", " ", "Hello, World's end", "don't WE'LL 123 ab1", "a" * 3000, "<|endoftext|>x<|startoftext|>", "<|endoftext |>", "<| endoftext|> <|endoftext|>", "e ́á ́", "ᄀ ᅡ가",
    "ΑΣ Σ ΟΔΟΣ", "İstanbul ß ŒUVRE", "!\x1c!\x1d?\x85? .　. \xa0", "' s 't it'\ns", "日本語 한국어 😀😀", "\x00a \x0b\x0cb", "9" * 50 + " " + "x9" * 40,
]


def test_what_can_be_split():
    assert [COUNTERS[n].splits for n in FILES] == [True, False, False]


@pytest.mark.parametrize("name", FILES)
def test_as_the_library(name):
    assert COUNTERS[name].counts([t.encode() for t in HARD]) == [LIBRARY[name](t) for t in HARD]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x0c\r'sS<|>0é́")), max_size=40), max_size=6))
def test_any_texts(texts):
    assert COUNTERS[FILES[0]].counts([t.encode() for t in texts]) == [LIBRARY[FILES[0]](t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\té"), max_size=60).map(str.encode), st.integers(1, 9))
def test_blocks_end_at_white_space(text, most):
    made = list(tokencount.blocks(text, most))
    assert b"".join(made) == text and all(b[:1].isspace() for b in made[1:])
    assert sum((b.split() for b in made), []) == text.split()


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_PIECES", 10)
    monkeypatch.setattr(tokencount, "CACHE_BYTES", 6)
    counter = tokencount.Counter(COUNTERS[FILES[0]].lengths, True)
    for i in range(30):
        text = f"w{i} w{i + 1} common a-rather-long-piece-{i}"
        assert counter.counts([text.encode()]) == [LIBRARY[FILES[0]](text)]
        assert len(counter) <= 10 and len(counter.old) <= 10


def test_byte_batches():
    assert [len(b) for b in tokencount.byte_batches([b"x" * 9, b"x" * 3, b"x" * 3, b"x" * 2], 6)] == [1, 2, 1]
    assert list(tokencount.byte_batches([])) == []


def test_hard_rows(spark):
    long = "The quick brown fox's 42 jumps.\n" * 120_000
    rows = [(1, None, "x"), (2, "", "y"), (3, long, None), (3, long, None), (4, "é" * 5, ""), (None, "Some words", ""), (5, "a1" * 600_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(tokencount.token_counts(docs).collect(), key=repr)
    want = [(i, len((t or "").encode()), n := LIBRARY[FILES[0]](t or ""), n > 2048) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokencount.token_counts(docs.where("false")).collect() == []
    for name in FILES[1:]:
        few = docs.where("doc_id in (1, 2, 4)")
        assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(few, name).collect()} == {1: 0, 2: 0, 4: LIBRARY[name]("é" * 5)}
