"""All queries outside the llm subpackage."""

from __future__ import annotations

from genoloom.plans import feeds, genetics, lines, loads, quality, stores

_PARTS = (genetics, stores, loads, quality, lines, feeds)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
