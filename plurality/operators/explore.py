"""Browsing a question export: filters, orders, running means, keyword picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = {
    "ours_desc": ("our_score", False),
    "ours_asc": ("our_score", True),
    "lift_desc": ("lift", False),
    "lift_asc": ("lift", True),
    "entropy_desc": ("truth_entropy", False),
    "entropy_asc": ("truth_entropy", True),
}


def keeps(
    kind: str | None = None,
    dataset: str | None = None,
    bucket: str | None = None,
    required_only: bool = False,
    search: str | None = None,
) -> Column:
    """Condition of one filter setting; empty settings keep everything."""
    keep = F.lit(True)
    for column, value in (("task_kind", kind), ("dataset", dataset), ("eval_bucket", bucket)):
        if value:
            keep = keep & (F.col(column) == value)
    if required_only:
        keep = keep & (F.col("required_question") != "")
    if search and search.strip():
        keep = keep & F.contains(F.lower("question_text"), F.lit(search.strip().lower()))
    return keep


def filter_export(rows: DataFrame, **setting) -> DataFrame:
    return rows.filter(keeps(**setting))


def summaries(rows: DataFrame, settings: Mapping[str, dict]) -> DataFrame:
    """Count and means of many filter settings in one pass: each row is counted under every filter it passes."""
    passed = F.array(*[F.when(keeps(**s), F.lit(n)) for n, s in settings.items()])
    tagged = rows.withColumn("view", F.explode(F.filter(passed, lambda v: v.isNotNull())))
    means = tagged.groupBy("view").agg(
        F.count(F.lit(1)).alias("n"), F.avg("our_score").alias("ours"), F.avg("base_score").alias("base")
    )
    return means.withColumn("lift", F.col("ours") - F.col("base"))


def ordered(rows: DataFrame, order: str = "ours_desc") -> DataFrame:
    column, up = ORDERS[order]
    return rows.orderBy(F.asc(column) if up else F.desc(column), "question_id")


def keyword_rows(df: DataFrame, text: str, words: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows whose text has any of the words, ignoring case."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(F.col(text)), F.lit(w.lower()))
    return df.filter(hit).orderBy(*order).limit(n)
