import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import periodic


def brute(words):
    """All runs, by trying every period at every place; the smallest period of a stretch is the first that fits."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(6, 4 * q):
                found.setdefault((i, k + q - i), q)
            i = k
    return sorted((s, length, q) for (s, length), q in found.items())


SMALL = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60)
PERIODIC = st.tuples(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=7), st.integers(1, 12), SMALL).map(lambda x: x[2] + x[0] * x[1] + x[2][:3])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(SMALL, PERIODIC), max_size=5))
def test_runs_as_brute(texts):
    assert periodic.runs(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_large_texts_as_brute(seed, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 8)  # sets of many blocks
    rng = random.Random(seed)
    line = [b"l%d" % i for i in range(7)]
    text = []
    while len(text) < 1500:
        unit = [b"u%d" % rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        text += rng.choice([line, line + [b"x%d" % rng.randrange(50)], unit * rng.randrange(1, 12)])
    assert periodic.runs([text, text[:700], []]) == [brute(text), brute(text[:700]), []]


def test_suffix_order():
    rng = np.random.default_rng(0)
    texts = [list(rng.integers(0, 3, n)) for n in (0, 40, 1, 0, 25)]
    words, ends = np.concatenate(texts).astype(np.int64), np.cumsum([0, *map(len, texts)])
    order, _, _ = periodic.suffix_order(words, ends)
    whole = [(t, list(words[i : ends[t + 1]])) for t in range(5) for i in range(ends[t], ends[t + 1])]
    assert [whole[i] for i in order] == sorted(whole)
    for i, j, common in zip(*periodic.edges(words, ends)):
        (_, a), (_, b) = whole[i], whole[j]
        assert common == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) >= 5


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 60))
def test_planted(doc_id, n):
    words = [b"%d" % i for i in range(n)]
    h = zlib.crc32(str(doc_id).encode())
    want = list(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            want[i] = words[a + (i - a) % p]
    assert periodic.planted(words, doc_id) == want


def test_collapsed():
    words = [b"%d" % i for i in range(20)]
    assert periodic.collapsed(words, [(0, 8, 2), (5, 8, 1)]) == [b"0", b"1"] + words[13:]
    assert periodic.collapsed(words, []) == words


def test_many_repeats_of_one_word():
    assert periodic.runs([[b"a"] * 60_000, [b"a", b"b"] * 3]) == [[(0, 60_000, 1)], []]


def test_hard_rows(spark):
    long = "lorem ipsum dolor sit " * 40_000 + "\x1f end"
    rows = [(1, None, "x"), (2, "", "y"), (3, long, None), (3, long, None), (4, " a\ta\na a\x0ba a b", ""), (None, "x y " * 9, ""), (5, "no repeats here", ""), (6, " \n ", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(periodic.digests(docs).collect(), key=repr)
    want = []
    for i, t, _ in rows:
        words = periodic.planted((t or "").encode().split(), i)
        found = brute(words) if len(words) < 1000 else [(0, 160_000, 4)]
        start, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        dropped = {k for s, m, p in found for k in range(s + p, s + m)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        told = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        want.append((i, len(found), start, length, q, q and 1000 * length // q, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert periodic.digests(docs.where("false")).collect() == []
    whole = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(x) for x in whole[4].runs] == [(0, 6, 1)] and whole[4].collapsed == "a b" and whole[5].runs == []


def test_query_as_brute(spark):
    texts = {i: " ".join(random.Random(i).choices("ab", k=i % 50)) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in periodic.periodic_runs(docs).collect():
        words = periodic.planted(texts[r.doc_id].encode().split(), r.doc_id)
        assert [tuple(x) for x in r.runs] == brute(words)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = periodic.op11_periodic_runs(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    want = con.execute(periodic.ORACLE)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.fetchall()))
