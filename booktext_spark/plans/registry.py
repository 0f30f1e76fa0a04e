"""Queries over the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

from booktext_spark.plans import library, reports, requests, revisions, texts

FLAGSHIP = "copying_audit"
MODULES = (texts, library, requests, revisions, reports)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
