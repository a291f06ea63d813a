"""Registered queries over the given tables, each with the same rows in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import captures, recordings, training

QUERIES = {**captures.QUERIES, **recordings.QUERIES, **training.QUERIES}
ORACLE_SQL = {**captures.ORACLE_SQL, **recordings.ORACLE_SQL, **training.ORACLE_SQL}
