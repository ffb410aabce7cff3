"""Statistics of state paths as column expressions.  A path is a string with a letter for each place's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.viterbi import LETTERS
from .constants import STATES, SUBGROUPS
from .dna import places

LETTER = dict(zip(STATES, LETTERS))


def count(path: Column, letters: str) -> Column:
    return F.length(path) - F.length(F.translate(path, letters, ""))


def over_length(n: Column, path: Column) -> Column:
    return n / F.greatest(F.length(path), F.lit(1))


def composition_deltas(ref: Column, alt: Column) -> dict[str, Column]:
    """Share of each state in the reference's path less that in the alternate's."""
    return {s: over_length(count(ref, x), ref) - over_length(count(alt, x), alt) for s, x in LETTER.items()}


def transition_deltas(ref: Column, alt: Column) -> dict[str, Column]:
    """Changes of each kind in the reference's path less those in the alternate's; two different letters never overlap."""
    moved = lambda p, x, y: (F.length(p) - F.length(F.replace(p, F.lit(x + y), F.lit("")))) / 2
    return {f"{s}_to_{t}": (moved(ref, x, y) - moved(alt, x, y)).cast("int") for s, x in LETTER.items() for t, y in LETTER.items() if s != t}


def parts(path: Column, flank: Column) -> tuple[Column, Column, Column]:
    """(variant, left neighbour, right neighbour): both flanks have the left one's length, neighbours half of it."""
    near = F.floor(flank / 2).cast("int")
    end = F.length(path) - flank
    return F.substr(path, flank + 1, F.greatest(end - flank, F.lit(0))), F.substr(path, flank - near + 1, near), F.substr(path, end + 1, near)


def groups() -> dict[str, str]:
    """Letters of every state and every group of states."""
    return LETTER | {g: "".join(LETTER[s] for s in members) for g, members in SUBGROUPS.items()}


def statistics(path: Column, names: dict[str, str]) -> dict[str, Column]:
    """Count, log2 of the count plus one over the length, and share of each group of letters."""
    out = {}
    for name, letters in names.items():
        n = count(path, letters)
        out |= {f"{name}_rawc": n, f"{name}_log2": F.log2(over_length(n + 1, path)), f"{name}_pctg": over_length(n, path)}
    return out


def gaussian_boundaries(path: Column, start: Column, size: Column) -> Column:
    """Sum over the places where the state changes of a Gaussian of their distance to [start, start + size], from 0.

    The deviation is the size; a size of 0 counts as 1.
    """
    sigma = F.greatest(size, F.lit(1)).cast("double")
    changes = F.filter(places(F.length(path) - 1), lambda i: F.substr(path, i, F.lit(1)) != F.substr(path, i + 1, F.lit(1)))
    far = lambda i: F.greatest(start - i, i - (start + size), F.lit(0)).cast("double")
    return F.aggregate(changes, F.lit(0.0), lambda a, i: a + F.exp(-far(i - 1) * far(i - 1) / (2 * sigma * sigma)))


def boundary_delta(ref: Column, alt: Column, left: Column, right: Column) -> Column:
    """Alternate less reference; both are held between the reference's neighbours, as the definition has it.

    Give columns, not expressions: a lambda would evaluate them for every place.
    """
    at = F.length(left)
    return gaussian_boundaries(F.concat(left, alt, right), at, F.length(alt)) - gaussian_boundaries(F.concat(left, ref, right), at, F.length(ref))
