import random
import tracemalloc
from itertools import product

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.config import DEFAULT, Config
from helixframe.functions.constants import CODONS, EMISSION, INITIAL, IUPAC, STATES, TRANSITION, stacking_energies
from helixframe.operators import align, domains, motifs, orf, structure, viterbi

DNA = st.text("ACGT", max_size=12)


def plain_table(a, b, pair, gap, local):
    rows = [[0 if local else gap * j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        above, row = rows[-1], [0 if local else gap * i]
        for j, y in enumerate(b, 1):
            best = max(above[j - 1] + pair(x, y), above[j] + gap, row[-1] + gap)
            row.append(max(best, 0) if local else best)
        rows.append(row)
    return rows


def plain_alignment(a, b, pair, gap, local):
    s, i, j = plain_table(a, b, pair, gap, local), len(a), len(b)
    if local:
        top = max(map(max, s))
        i = next(k for k, row in enumerate(s) if top in row)
        j = s[i].index(top)
    score, x, y = s[i][j], "", ""
    while (i or j) and not (local and s[i][j] == 0):
        if j and s[i][j - 1] + gap == s[i][j]:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
        elif i and s[i - 1][j] + gap == s[i][j]:
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
    return score, x, y


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", max_size=12), st.text("ACGTN", max_size=12)), max_size=6), st.sampled_from([1 << 22, 100]))
def test_alignments_as_cell_by_cell(pairs, cells):
    """Whole alignments of groups of pairs, of any sizes together, are those of filling one cell after another."""
    pair = lambda p, q: 1 if p == q else -1
    scores = {(p, q): 5 if p == q else -ord(q) % 3 for p in "ACGT" for q in "ACGT"}
    of = lambda p, q: scores.get((p, q), -8)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(align, "CELLS", cells)
        sides = [a for a, _ in pairs], [b for _, b in pairs]
        made = pd.concat([align.dna_rows(*sides), align.dna_texts(*sides)], axis=1).to_dict("records")
        protein = align.protein_rows([a for a, _ in pairs], [b for _, b in pairs], scores, -8).to_dict("records")
    assert len(made) == len(protein) == len(pairs)
    for (a, b), x, p in zip(pairs, made, protein):
        assert (x["Global_score"], x["global_ref"], x["global_alt"]) == plain_alignment(a, b, pair, -1, False)
        assert (x["Local_score"], x["local_ref"], x["local_alt"]) == plain_alignment(a, b, pair, -1, True)
        columns = list(zip(x["global_ref"], x["global_alt"]))
        assert x["Global_pct"] == pytest.approx(100 * sum(r == s for r, s in columns) / len(columns) if columns else 0)
        assert x["Local_pct"] == pytest.approx(100 * len(x["local_ref"]) / len(a) if a else 0)
        assert x["SNVs"] == (sum(r != s for r, s in columns) == 1 and ("-", "-") not in columns and all("-" not in c for c in columns))
        assert x["Insertion_length"] == sum(r == "-" for r, _ in columns)
        score, u, v = plain_alignment(a, b, of, -8, False)
        assert p["AA_Global_score"] == score and p["AA_Local_score"] == max(map(max, plain_table(a, b, of, -8, True)))
        assert p["AA_Global_pct"] == pytest.approx(100 * sum(r == s for r, s in zip(u, v)) / len(u) if u else 0)


@settings(max_examples=200, deadline=None)
@given(DNA, DNA)
def test_alignment(a, b):
    x = align.dna_alignment(a, b)
    assert x["global_ref"].replace("-", "") == a and x["global_alt"].replace("-", "") == b
    score = sum(1 if p == q else -1 for p, q in zip(x["global_ref"], x["global_alt"]))
    assert score == x["Global_score"] == align.dna_alignment(b, a)["Global_score"]
    assert x["Local_score"] >= max(0, x["Global_score"]) and x["local_ref"].replace("-", "") in a
    assert align.dna_alignment(a, a)["Global_score"] == len(a)
    pair = lambda p, q: 1 if p == q else -1
    best = max(map(max, plain_table(a, b, pair, -1, True)))
    assert best == x["Local_score"]


def test_long_alignments_in_little_memory():
    """A pair of 8,000 bases: the ways add up to the scores, and memory does not grow with rows times columns."""
    rng = random.Random(3)
    a = "".join(rng.choices("ACGT", k=8_000))
    b = "".join(rng.choice("ACGT") if rng.random() < 0.1 else c for c in a if rng.random() > 0.02)
    tracemalloc.start()
    x = align.dna_alignment(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    for whole, score, u, v in ((True, x["Global_score"], x["global_ref"], x["global_alt"]), (False, x["Local_score"], x["local_ref"], x["local_alt"])):
        assert score == sum(1 if p == q else -1 for p, q in zip(u, v))
        assert (u.replace("-", "") == a and v.replace("-", "") == b) if whole else (u.replace("-", "") in a and v.replace("-", "") in b)
    assert x["Insertion_length"] == x["global_ref"].count("-")


def test_alignment_of_known_gene():
    x = align.dna_alignment("GCTGCTGGACCTGCC", "G")
    assert (x["Global_score"], x["Local_score"], x["SNVs"], x["Insertion_length"]) == (-13, 1, 0, 0)
    assert x["Global_pct"] == pytest.approx(100 / 15) and x["Local_pct"] == pytest.approx(100 / 15)
    assert structure.entropy("GCTGCTGGACCTGCC") == pytest.approx(5.6879512682)
    assert structure.hairpins(["GCTGCTGGACCTGCC"]).tolist() == [2]
    s = "GCTGCTGGACCTGCC"
    assert sum(stacking_energies()[s[i : i + 2]] for i in range(14)) == pytest.approx(-22.66)


def brute_hairpins(s):
    n, found = len(s), 0
    comp = dict(zip("ATCG", "TAGC"))
    for i in range(n - 11):
        found += any(sum(comp.get(x, x) != y for x, y in zip(s[i : i + 4], s[j : j + 4])) <= 2 for j in range(i + 7, n - 3))
    return found if n > 11 else 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ACGTNR", max_size=40), max_size=5), st.sampled_from([1000, 2]))
def test_hairpins(sequences, together):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(structure, "TOGETHER", together)
        assert structure.hairpins(sequences).tolist() == [brute_hairpins(s) for s in sequences]


UNITS = st.lists(st.tuples(st.text("AC", min_size=1, max_size=6), st.integers(1, 9)), max_size=5).map(lambda x: "".join(u * n for u, n in x))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("AC", max_size=60), UNITS), max_size=4))
def test_tandem_runs_as_counts(windows):
    """Units counted one by one, runs sought from the left."""
    wanted = []
    for window in windows:
        want = {}
        for unit in {window[i : i + k] for k in range(2, 7) for i in range(len(window) - k + 1)}:
            if sum(window[i : i + len(unit)] == unit for i in range(len(window))) >= 5 and unit * 5 in window:
                i = n = 0
                while i < len(window):
                    run = 0
                    while window.startswith(unit * (run + 1), i):
                        run += 1
                    n, i = (n + run * len(unit), i + run * len(unit)) if run >= 5 else (n, i + 1)
                want[unit] = n
        wanted.append(want)
    assert structure.tandem_runs(windows) == wanted


def test_repeats():
    before, after = structure.tandem_runs(["CA" * 6, "CA" * 8 + "TG" * 5])
    assert before == {"CA": 12, "AC": 10} and after["CA"] == 16 and after["TG"] == 10
    x = structure.repeat_instability(before, after)
    assert x["tr_loci_gain"] == len(after) - 2 and x["tr_expansion_score"] == (16 - 12) + (after["AC"] - 10)
    swapped = structure.repeat_instability(after, before)
    assert swapped["tr_loci_lost"] == x["tr_loci_gain"] and swapped["Microsat_delta"] == -x["Microsat_delta"]
    assert set(structure.repeat_instability({}, {}).values()) == {0} and set(x) == set(structure.REPEATS)


def test_viterbi_as_all_paths():
    rng = random.Random(0)
    with np.errstate(divide="ignore"):
        start, move = np.log(INITIAL), np.log(np.array(TRANSITION)).T
    for n in range(1, 6):
        s = "".join(rng.choices("ACGTN", k=n))
        emit = [[np.log(np.mean([e["ACGT".index(b)] for b in IUPAC[c]])) for e in EMISSION] for c in s]
        value = lambda p: start[p[0]] + sum(move[a, b] for a, b in zip(p, p[1:])) + sum(emit[i][x] for i, x in enumerate(p))
        best = max(value(p) for p in product(range(len(STATES)), repeat=n))
        (path, _), total = viterbi.decode([s, "A" * 9])[0], viterbi.decode([s, "A" * 9])[1][0]
        assert len(path) == n and total == pytest.approx(best) and value([int(c) for c in path]) == pytest.approx(best)
    assert viterbi.decode(["", "A"])[0][0] == "" and viterbi.decode([])[0] == []


def test_domain_changes_of_equal_alleles():
    path = viterbi.decode(["ACGT" * 30])[0][0]
    x = dict(zip(domains._OF_SCALE, domains.changes(path, path, 0.0, 50)))
    assert len(domains.NAMES) == 411 and len(x) == 137
    assert all(v == 0 for k, v in x.items() if not k.startswith("RefNB"))


def test_orf():
    s = "CC" + "ATG" + "GCT" * 12 + "TAA" + "CC"
    start, end, score = orf.best_frame(s)
    assert (start, end) == (2, 2 + 3 + 36 + 3) and score == pytest.approx(4 + 42 / 10 * 100)
    assert orf.best_frame("CCCC") == (0, 4, 0.0)
    assert orf.plain(orf.translate("TAAATGGCTTAAGCT")) == "MA"
    assert orf.codon_residues("GCN") == ["A"] and set(orf.codon_residues("ANG")) == {CODONS["A" + b + "G"] for b in "ATCG"}
    back = orf.protein(s[::-1].translate(str.maketrans("ATCG", "TAGC")))
    assert back["reverse"] and back["protein"] == "M" + "A" * 12
    assert orf.protein("")["protein"] == ""
    assert orf.kozak("AAAATGGG" + "G" * 9, 3) == 5 and orf.kozak("AT", 0) == 0


def test_motifs():
    m = motifs.from_consensus("m", "init", "ACGN")
    batch = motifs.Batch(["ACGT", "AC", "TTACGA"], motifs.SYMBOLS)
    of, place, score = batch.windows(m)
    assert of.tolist() == [0, 2, 2, 2] and place.tolist() == [0, 0, 1, 2]
    assert score[0] == pytest.approx(3 * np.log2(0.91 / 0.25)) == score[3]
    assert m.threshold(1.0) == pytest.approx(score[0]) and m.threshold(0.0) < 0
    got = motifs.clusters(np.array([0, 0, 0, 1]), np.array([3, 5, 100, 2]), np.array([1.0, 2.0, 3.0, 4.0]), 2, 50)
    assert got.tolist() == [1.0, 0.0]
    one = pd.Series(["ACGTACGTAA"])
    flat = motifs.dna_profile(one, one, pd.Series(["A" * 200]), pd.Series(["C" * 200]), motifs.DNA_MOTIFS, DEFAULT)
    assert list(flat.columns) == motifs.dna_names(motifs.DNA_MOTIFS) and len(flat.columns) == 55 and not flat.to_numpy().any()
    p = motifs.protein_profile(pd.Series(["", "AAKRKAA"]), pd.Series(["KKKKRGYKAF", "AAKRKAA"]), motifs.PROTEIN_MOTIFS, DEFAULT)
    assert len(p.columns) == 27 and p["NLS_count_delta"].tolist()[0] > 0 and not p.iloc[1].any() and p["SH2_count_delta"][0] >= 1


def test_config():
    assert Config.from_yaml("k_min: 3\nunknown: 5\n").k_min == 3 and Config.from_yaml("") == DEFAULT
