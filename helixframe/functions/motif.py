"""Places of patterns as column expressions, for short sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import places


def pattern_places(s: Column, patterns: list[str]) -> Column:
    """Places, from 1, where any of the patterns matches."""
    starts = "|".join(f"(?:{p})" for p in patterns)
    return F.filter(places(F.length(s)), lambda i: F.substr(s, i, F.length(s)).rlike(f"^(?:{starts})"))


def place_clusters(found: Column, far: int) -> Column:
    """Neighbouring places, in the given order, that rise and are near."""
    gaps = F.zip_with(found, F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: b - a)
    return F.size(F.filter(gaps, lambda g: (g > 0) & (g <= far)))
