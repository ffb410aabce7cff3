"""Window features that need a sequence as a whole: hairpins and tandem repeats, in Arrow batches."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .texts import Texts, over_texts

STEM, LOOP, MISMATCHES = 4, 3, 2
_PAIR = np.arange(256, dtype=np.uint8)
_PAIR[[65, 84, 67, 71]] = [84, 65, 71, 67]
#: Sequences that are searched together.
TOGETHER = 1000


def hairpins(sequences: list[str]) -> np.ndarray:
    """Stems of each sequence with a complementary stem behind a loop.

    Two stems pair if at most MISMATCHES of their bases, in the same order, are not complements; the last possible first
    stem is not tried, as the definition has it.  Such stems agree in STEM - MISMATCHES places at least, so a stem has a
    partner if the last stem with the complements of its bases in some choice of so many places is far enough.
    """
    return hairpins_of(Texts.of(sequences))


def hairpins_of(texts: Texts) -> np.ndarray:
    """hairpins() of texts."""
    parts = [_hairpins(texts.rows(i, i + TOGETHER)) for i in range(0, len(texts), TOGETHER)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _hairpins(texts: Texts) -> np.ndarray:
    n, sizes, text = len(texts), texts.sizes, texts.bytes
    present = np.bincount(text, minlength=256) > 0
    present[_PAIR[np.flatnonzero(present)]] = True
    number = np.cumsum(present) - 1
    code, other, letters = number[text], number[_PAIR[text]], int(present.sum())
    stems = np.maximum(sizes - STEM + 1, 0)
    of = np.repeat(np.arange(n), stems)
    place = np.arange(len(of)) - np.repeat(np.cumsum(stems) - stems, stems)
    at = texts.starts[of] + place
    mine, wanted = [code[at + k] for k in range(STEM)], [other[at + k] for k in range(STEM)]
    far, row = np.full(len(of), -1), of * letters ** (STEM - MISMATCHES)
    for chosen in combinations(range(STEM), STEM - MISMATCHES):
        key, sought = 0, 0
        for k in chosen:
            key, sought = key * letters + mine[k], sought * letters + wanted[k]
        last = np.full(n * letters ** len(chosen), -1)
        last[row + key] = place  # places rise, and the last one stays
        np.maximum(far, last[row + sought], out=far)
    found = (far >= place + STEM + LOOP) & (place < sizes[of] - 2 * STEM - LOOP)
    return np.bincount(of[found], minlength=n)


def duplications_of(ref: Texts, alt: Texts, config: Config) -> np.ndarray:
    """Number of distinct units of min_repeat to max_repeat bases that stand twice in a row in an alternate window and nowhere in the reference's."""
    n, codes, ends = len(alt), alt.bytes, np.repeat(alt.starts + alt.sizes, alt.sizes)
    of, units = [], []
    whole, others, mine = alt.bytes.tobytes().decode("latin-1"), ref.strings(), np.repeat(np.arange(n), alt.sizes)
    for k in range(config.min_repeat, config.max_repeat + 1):
        if len(codes) < 2 * k:
            break
        alike = np.append(0, np.cumsum(codes[:-k] == codes[k:]))  # of so many places, those that are equal to the one k on
        at = np.flatnonzero(alike[k:] - alike[:-k] == k)
        at = at[at + 2 * k <= ends[at]]
        of += mine[at].tolist()
        units += [whole[i : i + k] for i in at.tolist()]
    lacking = [i for i, unit in set(zip(of, units)) if unit not in others[i]]
    return np.bincount(np.array(lacking, dtype=np.intp), minlength=n)


def duplications(ref: Column, alt: Column, config: Config = DEFAULT) -> Column:
    """duplications_of() two windows.  Nulls count as empty."""
    return over_texts(lambda a, b: {"found": duplications_of(a, b, config)}, {"found": "int"}, [ref, alt])["found"]


def stretches(text: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches [start, end) in which symbols k apart are equal, of at least so many symbols, in order."""
    same = np.zeros(max(len(text) - k, 0) + 2, dtype=np.int8)
    same[1:-1] = text[: len(text) - k] == text[k:] if len(text) > k else same[1:-1]
    steps = np.diff(same)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) + k
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def tandem_runs(windows: list[str], config: Config = DEFAULT) -> list[dict[str, int]]:
    """Bases in runs of each unit that a window repeats min_repeats times, leftmost runs first.

    All runs of a unit of k bases lie in maximal stretches of period k, found for all windows at once; a stretch holds a
    run of each of its rotations.  A unit that repeats so often in a window does so in the sequence around it, too.
    """
    least, out = config.min_repeats, [{} for _ in windows]
    texts = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for w in windows]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    whole = np.concatenate([np.append(t, 0x110000 + i) for i, t in enumerate(texts)] or [np.zeros(0, np.uint32)]).astype(np.uint32)  # a mark that repeats nothing
    for k in range(config.k_min, config.k_max):
        ends: dict[tuple[int, str], int] = {}  # where a unit's last run ends
        for a, b in stretches(whole, k, least * k):
            i = int(np.searchsorted(starts, a, side="right")) - 1
            s, a, b = windows[i], a - int(starts[i]), b - int(starts[i])
            tried = set()
            # all rotations begin within k places, or within k more where a run of the stretch before reaches into this one
            for at in range(a, min(b - least * k + 1, a + 2 * k)):
                unit = s[at : at + k]
                if unit in tried or at < ends.get((i, unit), 0):
                    continue
                tried.add(unit)
                n = (b - at) // k * k
                out[i][unit], ends[i, unit] = out[i].get(unit, 0) + n, at + n
    return out


REPEATS = [
    "tr_base_composite", "Microsat_delta", "tr_loci_lost", "tr_loci_gain", "tr_bp_gain", "tr_bp_loss", "tr_expansion_score", "tr_contraction_score", "tr_weighted_bploss",
    "tr_weighted_bpgain", "tr_weighted_expansion_score", "tr_weighted_contraction_score", "tr_composite_score",
]


def repeat_instability(before: dict[str, int], after: dict[str, int]) -> dict[str, int]:
    """How the runs changed: units lost, gained and shared, in bases and weighted by the unit's length."""
    lost, gained = before.keys() - after.keys(), after.keys() - before.keys()
    shift = {u: after[u] - before[u] for u in before.keys() & after.keys()}
    grown, shrunk = {u: d for u, d in shift.items() if d > 0}, {u: -d for u, d in shift.items() if d <= 0}
    out = {
        "Microsat_delta": len(after) - len(before),
        "tr_loci_lost": len(lost),
        "tr_loci_gain": len(gained),
        "tr_bp_gain": sum(after[u] for u in gained),
        "tr_bp_loss": sum(before[u] for u in lost),
        "tr_expansion_score": sum(grown.values()),
        "tr_contraction_score": sum(shrunk.values()),
        "tr_weighted_bploss": sum(before[u] * len(u) for u in lost),
        "tr_weighted_bpgain": sum(after[u] * len(u) for u in gained),
        "tr_weighted_expansion_score": sum(d * len(u) for u, d in grown.items()),
        "tr_weighted_contraction_score": sum(d * len(u) for u, d in shrunk.items()),
    }
    out["tr_base_composite"] = out["tr_bp_gain"] + out["tr_bp_loss"] + sum(shift.values())
    weighted = ("tr_weighted_bploss", "tr_weighted_bpgain", "tr_weighted_expansion_score", "tr_weighted_contraction_score")
    out["tr_composite_score"] = len(lost) + len(gained) + sum(out[k] for k in weighted)
    return out


def hairpin_delta(ref: Column, alt: Column) -> Column:
    """Change of the number of hairpins between two windows.  Nulls count as empty."""

    return over_texts(lambda a, b: {"change": hairpins_of(b) - hairpins_of(a)}, {"change": "int"}, [ref, alt])["change"]


def repeat_changes(ref: Column, alt: Column, config: Config = DEFAULT) -> Column:
    """A struct of REPEATS, from the windows of both alleles.  Nulls count as empty."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [repeat_instability(x, y) for x, y in zip(*(tandem_runs(s.fillna("").tolist(), config) for s in (a, b)))]
        return pd.DataFrame(rows, columns=REPEATS)

    return F.pandas_udf(run, ", ".join(f"{c} int" for c in REPEATS))(ref, alt)


def tandem_units(window: Column, config: Config = DEFAULT) -> Column:
    """An array of (unit, bases) of the runs of a window, by unit.  Nulls count as empty."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"unit": u, "bases": n} for u, n in sorted(x.items())] for x in tandem_runs(s.fillna("").tolist(), config)])

    return F.pandas_udf(run, "array<struct<unit: string, bases: bigint>>")(window)


#: Cells of the table of substrings that are sorted together.
SORTED = 1 << 20


def entropies(sequences: list[str], config: Config = DEFAULT) -> np.ndarray:
    """Entropy in bits of all substrings of k_min to k_max bases together, of each sequence; 0 without any.

    Sequences of like lengths are a table of numbered substrings, a row for each; its rows are sorted, so that equal
    substrings stand together.
    """
    out = np.zeros(len(sequences))
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    order, at = np.argsort(-sizes, kind="stable"), 0
    while at < len(order) and (width := sizes[order[at]]) >= config.k_min:
        columns = int(sum(max(width - k + 1, 0) for k in range(config.k_min, config.k_max + 1)))
        group = order[at : at + max(SORTED // columns, 1)]
        out[group] = _entropies([sequences[i] for i in group], sizes[group], config)
        at += len(group)
    return out


def _entropies(sequences: list[str], sizes: np.ndarray, config: Config) -> np.ndarray:
    n, width = len(sequences), int(sizes.max())
    text = np.zeros((n, width), dtype=np.int64)
    inside = np.arange(width) < sizes[:, None]
    letters, text[inside] = np.unique(np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    tables = []
    for k in range(config.k_min, min(config.k_max, width) + 1):
        code = np.zeros((n, width - k + 1), dtype=np.int64)
        for j in range(k):
            code = code * len(letters) + text[:, j : width - k + 1 + j]
        tables.append(np.where(inside[:, k - 1 :], code * (config.k_max + 1) + k, -1))
    table = np.concatenate(tables, axis=1)
    table.sort(axis=1)
    starts = np.ones(table.shape, dtype=bool)
    starts[:, 1:] = table[:, 1:] != table[:, :-1]
    begins = np.flatnonzero(starts)
    counts, row = np.diff(np.append(begins, table.size)), begins // table.shape[1]
    counts = np.where(table.ravel()[begins] >= 0, counts, 0)
    total = np.bincount(row, counts, minlength=n)
    own = np.bincount(row, counts * np.log2(np.maximum(counts, 1)), minlength=n)
    return np.log2(np.maximum(total, 1)) - own / np.maximum(total, 1)


def entropy(s: str, config: Config = DEFAULT) -> float:
    return float(entropies([s], config)[0])


def entropy_delta(ref: Column, alt: Column, config: Config = DEFAULT) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(entropies(b.fillna("").tolist(), config) - entropies(a.fillna("").tolist(), config))

    return F.pandas_udf(run, "double")(ref, alt)
