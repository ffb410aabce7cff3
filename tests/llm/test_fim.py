import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import fim

LETTERS = st.text(st.sampled_from("abZ é\n<PSM>1\x0b ſK😀"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_ranks_as_counts(symbols):
    matrix, places = fim.WaveletMatrix(np.array(symbols, dtype=np.uint8), 3), np.arange(len(symbols) + 1)
    for s in range(8):
        assert matrix.rank(s, places).tolist() == [symbols[:i].count(s) for i in places]


def test_ranks_of_long_vectors():
    bits = np.random.default_rng(1).integers(0, 2, 70_000).astype(bool)
    at = np.array([0, 1, 63, 64, 65, 4095, 65_535, 65_536, 70_000])
    assert fim.Bits(bits).rank(at).tolist() == [int(bits[:i].sum()) for i in at]


def brute(doc_id, text):
    """The contract, told token by token."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 10**12)), LETTERS), min_size=1, max_size=12))
def test_slice_as_brute(rows):
    got = fim.formed([i for i, _ in rows], [t for _, t in rows], 1, fim.PLAIN, fim.SUFFIX_FIRST)
    assert list(zip(got["n"], got["form"], got["prefix_chars"], got["middle_chars"], got["output"])) == [brute(*r) for r in rows]
    assert [fim.restore(o, f) for o, f in zip(got["output"], got["form"])] == [t for _, t in rows]


def test_hard_rows(spark):
    long = "word, é\n" * 300_000
    rows = [(1, None, "x"), (2, "", "y"), (3, long, None), (3, long, None), (4, "a<S>b", ""), (None, "Some words here", ""), (5, "x" * 2_000_000, ""), (6, "a<S" * 3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = fim.fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *brute(i, t))) for i, t, _ in rows)
    assert fim.digests(docs.where("false")).collect() == []


def test_shares(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text")
    found = {r["form"]: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert 220 < found["plain"] < 380 and 440 < found["spm"] < 640
    assert {r["form"] for r in fim.fill_in_middle(docs, plain=0, suffix_first=100).select("form").distinct().collect()} == {"spm"}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = fim.op12_fill_in_middle(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    want = con.execute(fim.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
