"""Table profile in one pass per kind of column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.plans.ranking import quantiles
from plurality.plans.skew import one_row


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns at once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """min, exact median, max and distinct count of one numeric column."""
    values = df.select(F.col(column).cast("double").alias("v"))
    ends = values.agg(F.min("v").alias("min"), F.max("v").alias("max")).first()
    lo, hi = (ends["min"] or 0.0), (ends["max"] or 1.0)
    median = quantiles(values, [], "v", {"median": 0.5}, lo, hi if hi > lo else lo + 1.0)
    stats = values.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count_distinct("v").alias("distinct"))
    return one_row(stats, median).select(F.lit(column).alias("column"), "*")
