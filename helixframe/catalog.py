"""Registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from .plans import base, files, learning, modeling, sqlqueries

FLAGSHIP = "fingerprint_all"
QUERIES: dict = {**base.QUERIES, **learning.QUERIES, **modeling.QUERIES, **files.QUERIES, **sqlqueries.QUERIES}
ORACLES: dict[str, str] = {**base.ORACLES, **learning.ORACLES, **modeling.ORACLES, **files.ORACLES, **sqlqueries.ORACLES}
