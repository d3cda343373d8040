"""Named queries over the tables, each with the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scoring", "ingest", "splitting", "errors", "calibration", "segmenting", "answering", "comparing", "wording", "people", "logs")


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"plurality.catalog.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
