"""All registered queries of the claims engine, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import changing, detecting, extracting, reading, searching, stored, streamed, texts, upkeep

_PARTS = (reading, changing, detecting, extracting, searching, texts, streamed, upkeep, stored)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
