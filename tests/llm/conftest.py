from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) with columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), 7, 8.0, "x", 9) for r in rows]
        kind = "doc_id long, text string, lang string, source string, n_chars long, size int, keep double, row string, n int"
        return spark.createDataFrame(full, kind)

    return make
