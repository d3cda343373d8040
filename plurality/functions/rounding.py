"""Rounding that agrees between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(column: Column | str) -> Column:
    """Six decimals; the tiny shift settles exact ties and negative zero the same way in every engine."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + 1e-9, 6)
