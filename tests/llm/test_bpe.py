import hashlib
from unicodedata import ucd_3_2_0

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
OURS = bpe.WordBpe(bpe.load())
THEIRS = tokenizers.Tokenizer.from_file(bpe.default_path())
# characters that any version of the Unicode tables knows; newer ones differ between libraries
OLD = st.characters(exclude_categories=["Cs"]).filter(lambda c: ucd_3_2_0.category(c) != "Cn")
HARD = [
    "", " ", "Hello, World's end", "don't WE'LL 123 ab1", "a" * 3000, "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>",
    "ΑΣ Σ ΟΔΟΣ", "İstanbul ß ŒUVRE", "éà", "\x1c\x1d tab\tnew\nline\x85 ​　", "\x00a", "日本語 한국어 😀😀",
]


@pytest.mark.parametrize("text", HARD)
def test_as_the_library(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(OLD, max_size=60))
def test_any_text(text):
    assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_query(spark):
    rows = [(1, "The cat's 42", "clash"), (2, None, None), (3, "", "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert got[2].n_tokens == got[3].n_tokens == 0
    assert got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = THEIRS.encode("The cat's 42", add_special_tokens=False).ids
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digests(docs.where("false")).collect() == []
    whole = {r.doc_id: r for r in bpe.with_tokens(docs).collect()}
    assert list(whole[1].ids) == ids and whole[2].ids == []
