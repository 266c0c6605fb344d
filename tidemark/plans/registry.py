"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from tidemark.plans import ordered, placed, scans, streams, versions

_FAMILIES = (scans, ordered, placed, versions, streams)

QUERIES: dict = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLES: dict = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
