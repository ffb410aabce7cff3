import numpy as np
import xxhash

from helixframe.llm import simhash


def brute_print(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_print():
    for text in ["", " \n", "One", "one TWO", "A b c", "É ß é x\x85y z\x0bw", "a b c d e f g a b c", "x " * 40_000]:
        assert simhash.fingerprint(text.encode()) == brute_print(text)


def family(rng, n, flips):
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    return [int(centre) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips + 1), replace=False)) for _ in range(n)]


def test_links_as_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    codes = sorted({c for n, flips in [(1, 0)] * 300 + [(40, 2), (60, 3), (80, 5), (50, 9)] for c in family(rng, n, flips)} | {0, 7, (1 << 64) - 1})
    prints = {i * 3 + 1: c for i, c in enumerate(codes)}
    want = brute_components(prints)
    nodes = spark.createDataFrame([(int(np.uint64(c).view(np.int64)), i) for i, c in prints.items()], "fp long, node long")
    for limit in (1024, 16, 4):  # plain groups, groups keyed again, groups dealt over pairs of blocks
        monkeypatch.setattr(simhash, "LARGE_GROUP", limit)
        found = {r.id: r.component_id for r in simhash.components(simhash.near_links(nodes)).collect()}
        assert {i: found.get(i, i) for i in prints} == want
    monkeypatch.setattr(simhash, "block_keys", lambda n: [simhash._mask([64 * i // 6 for i in range(7)], c) for c in simhash.combinations(range(6), 3)])
    found = {r.id: r.component_id for r in simhash.components(simhash.near_links(nodes)).collect()}
    assert {i: found.get(i, i) for i in prints} == want


def test_index_large_group():
    rng = np.random.default_rng(2)
    codes = np.unique(np.array(family(rng, 3000, 3), dtype=np.uint64))
    label = simhash.forest(len(codes), simhash.GrayIndex(np.zeros(len(codes), dtype=np.int64), codes).links())
    want = brute_components(dict(enumerate(int(c) for c in codes[:400])))
    small = simhash.forest(400, simhash.GrayIndex(np.zeros(400, dtype=np.int64), codes[:400]).links())
    assert [want[i] for i in range(400)] == small.tolist() and len(set(label)) < len(codes)


def test_edges(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
    rows = [(5, base * 20, "c", 1), (3, base.upper() * 20, "c", 1), (9, None, "c", 1), (8, "", "c", 1), (2, "entirely other words stand here today", "c", 1)]
    rows += [(None, base * 20, "c", 1), (None, "lone text of a null id", "c", 1), (7, "w " * 50_000, "c", 1), (7, "w " * 50_000, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int")
    got = simhash.near_components(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of == {5: 3, 3: 3, 9: 8, 8: 8, 2: 2, 7: 7}
    assert sorted(r.component_id or -1 for r in got if r.doc_id is None) == [-1, 3]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 7, 8]
    assert simhash.near_components(docs.where("false")).collect() == []


def test_several_texts_of_an_id(spark):
    """A doc_id's texts are one document, so what links to either is linked; a null id can be what links two others."""
    a, b, c = ("one two three four five six seven " * 9, "red green blue white black grey pink " * 9, "mon tue wed thu fri sat sun jan feb " * 9)
    docs = spark.createDataFrame([(4, a), (4, b), (9, b), (6, a), (7, c), (None, c), (None, c)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()} == {4: 4, 9: 4, 6: 4, 7: 7, None: 7}
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(4, a), (7, c)]
    assert len(simhash.drop_near_duplicates(docs.where("doc_id is null")).collect()) == 1


def test_query_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in docs.items()}
    want = brute_components(prints)
    got = simhash.op4_simhash_gray(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
