"""Open reading frames, translation and ambiguous codons, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from ..config import DEFAULT
from ..functions.constants import CODONS, IUPAC, PROPERTIES, RESIDUES, START_SCORES, SYMBOLS
from .texts import Texts, over_texts

_STARTS = re.compile("|".join(START_SCORES))
_TO_STOP = re.compile(f"(?s)(?:...)*?(?:{'|'.join(c for c, a in CODONS.items() if a == '_')})")
_COMPLEMENT = str.maketrans("ATCG", "TAGC")
SCHEMA = "residues array<array<string>>, protein string, length int, score double, start int, end int, reverse boolean"


def kozak(s: str, start: int) -> int:
    """Context of a start: 3 for a purine three bases before it, 2 for a G five bases behind it, as the definition counts."""
    if start < 3 or start + 6 >= len(s):
        return 0
    return 3 * (s[start - 3] in "AG") + 2 * (s[start + 4] == "G")


def best_frame(s: str, least: int = DEFAULT.min_protein) -> tuple[int, int, float]:
    """(start, end, score) of the best open reading frame; the whole sequence with score 0 if there is none.

    A frame runs from a start codon to its first stop in frame and has at least so many codons; starts do not
    overlap, the first of equal scores wins.
    """
    best = (0, len(s), 0.0)
    for m in _STARTS.finditer(s):
        a = m.start()
        stop = _TO_STOP.match(s, a + 3)
        if stop is not None and stop.end() - 3 - a >= 3 * least:
            score = START_SCORES[m[0]] + kozak(s, a) + (stop.end() - a) / least * 100
            if score > best[2]:
                best = (a, stop.end(), float(score))
    return best


def codon_residues(codon: str) -> list[str]:
    """Residues a codon may stand for; ambiguous codons have several, each once, in order of their bases."""
    if codon in CODONS:
        return [CODONS[codon]]
    bases = [IUPAC.get(b, "") for b in codon]
    return list(dict.fromkeys(CODONS[a + b + c] for a in bases[0] for b in bases[1] for c in bases[2]))


def translate(s: str) -> list[list[str]]:
    """Residues from the first codon on; stops before the first residue are skipped, the next one ends the protein."""
    out: list[list[str]] = []
    for i in range(0, len(s) - 2, 3):
        found = codon_residues(s[i : i + 3])
        if found == ["_"]:
            if out:
                break
            continue
        if found:
            out.append(found)
    return out


def plain(residues: list[list[str]]) -> str:
    """Each place's commonest residue, of equally common ones the first; stops among several are left out."""
    return "".join(Counter([r for r in place if r != "_"] or ["X"]).most_common(1)[0][0] for place in residues)


def protein(s: str, least: int = DEFAULT.min_protein) -> dict:
    """The protein of the better strand's best frame; the forward strand wins ties."""
    back = s[::-1].translate(_COMPLEMENT)
    forward, reverse = best_frame(s, least), best_frame(back, least)
    turned = reverse[2] > forward[2]
    start, end, score = reverse if turned else forward
    residues = translate((back if turned else s)[start:end])
    return {"residues": residues, "protein": plain(residues), "length": len(residues), "score": score, "start": start, "end": end, "reverse": turned}


# ---- the same for all sequences of a batch at once ----

#: Numbers of symbols, of which the last stands for all that are no base.
_NUMBER = np.full(256, len(SYMBOLS), dtype=np.int16)
_NUMBER[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
_BASE = len(SYMBOLS) + 1
_PAIR = np.arange(256, dtype=np.uint8)
_PAIR[[ord(c) for c in "ATCG"]] = [ord(c) for c in "TAGC"]


def codon_number(codon: str) -> int:
    return int(_NUMBER[[ord(c) for c in codon]].astype(int) @ [_BASE**2, _BASE, 1])


@cache
def codon_tables() -> dict[str, np.ndarray]:
    """By codon: its residues end to end and how many there are, the commonest one's letter (0 for none), whether it is a stop, a start's score, sums of properties."""
    found = [codon_residues((SYMBOLS + "?")[i // _BASE**2] + (SYMBOLS + "?")[i // _BASE % _BASE] + (SYMBOLS + "?")[i % _BASE]) for i in range(_BASE**3)]
    counts = np.array([len(x) for x in found])
    starts = np.zeros(len(found))
    starts[[codon_number(c) for c in START_SCORES]] = list(START_SCORES.values())
    stops = np.zeros(len(found), dtype=bool)
    stops[[codon_number(c) for c, a in CODONS.items() if a == "_"]] = True
    mean = lambda p, place: sum((p.get(r, 0.0) for r in place), 0.0) / max(len(place), 1)
    properties = {k: np.array([mean({r: float(x) for r, x in zip(RESIDUES, v)}, place) for place in found]) for k, v in PROPERTIES.items()}
    return {
        "counts": counts, "first": np.cumsum(counts) - counts, "residues": np.frombuffer("".join("".join(x) for x in found).encode(), dtype=np.uint8),
        "letter": np.array([ord(plain([x])) if x and x != ["_"] else 0 for x in found], dtype=np.uint8), "ends": np.array([x == ["_"] for x in found]), "starts": starts, "stops": stops,
    } | properties


def both_strands(texts: Texts) -> Texts:
    """Texts, and behind them their other strands, in order."""
    n = len(texts)
    turned = _PAIR[texts.bytes[::-1]]  # of the last text first
    at = np.repeat((np.cumsum(texts.sizes[::-1]) - texts.sizes[::-1])[::-1] - texts.starts, texts.sizes)
    return Texts(np.concatenate([texts.bytes, turned[np.arange(len(turned)) + at] if n else turned]), np.concatenate([texts.sizes, texts.sizes]))


def numbers(texts: Texts) -> np.ndarray:
    """The number of the codon at every place but the last two, whatever text it ends in."""
    x = _NUMBER[texts.bytes]
    return (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:]


def best_frames(texts: Texts, codons: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_frame() of each text."""
    tables, n = codon_tables(), len(texts)
    starts, ends = texts.starts, texts.starts + texts.sizes
    a, b, top = np.zeros(n, dtype=np.intp), texts.sizes.astype(np.intp), np.zeros(n)
    of = np.repeat(np.arange(n, dtype=np.int32), texts.sizes)[: len(codons)]
    at = np.flatnonzero(tables["starts"][codons] > 0)
    at = at[at + 3 <= ends[of[at]]]
    if not len(at):
        return a, b, top
    # starts overlap by one base at most, and of a chain of such ones every other is taken
    apart = np.ones(len(at), dtype=bool)
    apart[1:] = (np.diff(at) != 2) | (of[at[1:]] != of[at[:-1]])
    place = np.arange(len(at))
    at = at[(place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 0]
    stops = np.flatnonzero(tables["stops"][codons])
    end = np.full(len(at), len(texts.bytes) + 1)
    for frame in range(3):
        mine, own = at % 3 == frame, np.append(stops[stops % 3 == frame], len(texts.bytes) + 1)
        end[mine] = own[np.searchsorted(own, at[mine] + 3)]
    end += 3
    good = (end <= ends[of[at]]) & (end - 3 - at >= 3 * least)
    at, end = at[good], end[good]
    mine = of[at]
    start = at - starts[mine]
    inside = (start >= 3) & (start + 6 < texts.sizes[mine])
    before, behind = texts.bytes[np.where(inside, at - 3, 0)], texts.bytes[np.where(inside, at + 4, 0)]
    near = np.where(inside, 3 * ((before == ord("A")) | (before == ord("G"))) + 2 * (behind == ord("G")), 0)
    score = tables["starts"][codons[at]] + near + (end - at) / least * 100
    order = np.lexsort((at, -score, mine))
    first = order[np.append(True, np.diff(mine[order]) > 0)[: len(order)]]
    a[mine[first]], b[mine[first]], top[mine[first]] = start[first], end[first] - starts[mine[first]], score[first]
    return a, b, top


def translated(codons: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codons, how many of each): translate() of stretches of so many bases from a place on, the places of residues end to end."""
    tables, counts = codon_tables(), size // 3
    of = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    found = codons[np.repeat(begin - 3 * first, counts) + 3 * np.arange(len(of))]
    ends, residue = tables["ends"][found], tables["letter"][found] > 0
    said = np.cumsum(residue)
    said -= np.repeat(np.append(0, said)[first], counts)
    over = np.cumsum(ends & (said > 0))
    over -= np.repeat(np.append(0, over)[first], counts)
    kept = residue & (over == 0)
    return found[kept], np.bincount(of[kept], minlength=len(counts))


def strings(letters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts of so many letters each."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def found_proteins(texts: Texts, least: int, residues: bool) -> dict:
    """protein() of each text.  residues: whether places' residues are wanted."""
    tables, n, both = codon_tables(), len(texts), both_strands(texts)
    codons = numbers(both)
    a, b, top = best_frames(both, codons, least)
    turned = top[n:] > top[:n]
    pick = np.arange(n) + n * turned
    found, sizes = translated(codons, both.starts[pick] + a[pick], b[pick] - a[pick])
    out = {"protein": strings(tables["letter"][found], sizes), "length": sizes, "score": top[pick], "start": a[pick], "end": b[pick], "reverse": turned}
    of = np.repeat(np.arange(n), sizes)
    out |= {k: np.bincount(of, tables[k][found], minlength=n) for k in PROPERTIES}
    if residues:
        counts = tables["counts"][found]
        letters = tables["residues"][np.repeat(tables["first"][found] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        out["residues"] = lists(lists(strings(letters, np.ones(len(letters), dtype=np.intp)), counts), sizes)
    return out


FIELDS = dict(f.rsplit(" ", 1) for f in SCHEMA.split(", "))
#: What proteins() gives without residues: their sums of properties, a place of several counting their mean.
SUMMED = {k: v for k, v in FIELDS.items() if k != "residues"} | {k: "double" for k in PROPERTIES}


def proteins(s: Column, least: int = DEFAULT.min_protein, residues: bool = False) -> Column:
    """A struct of SUMMED, or of SCHEMA with residues.  Nulls count as empty; an empty sequence has an empty protein."""
    return over_texts(lambda texts: found_proteins(texts, least, residues), FIELDS if residues else SUMMED, [s])


def first_frames(s: Column) -> Column:
    """A struct of `protein`: residues of the first frame up to the first stop after a residue; X for codons that are not of four bases."""

    def run(texts: Texts) -> dict:
        counts = texts.sizes // 3
        first, of = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        letters = frame_letters()[numbers(texts)[np.repeat(texts.starts - 3 * first, counts) + 3 * np.arange(len(of))]]
        ends = letters == ord("_")
        said = np.cumsum(~ends)
        said -= np.repeat(np.append(0, said)[first], counts)
        over = np.cumsum(ends & (said > 0))
        over -= np.repeat(np.append(0, over)[first], counts)
        kept = ~ends & (over == 0)
        return {"protein": strings(letters[kept], np.bincount(of[kept], minlength=len(counts)))}

    return over_texts(run, {"protein": "string"}, [s])


@cache
def frame_letters() -> np.ndarray:
    out = np.full(_BASE**3, ord("X"), dtype=np.uint8)
    for codon, residue in CODONS.items():
        out[codon_number(codon)] = ord(residue)
    return out
