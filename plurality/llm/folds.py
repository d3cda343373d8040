"""Held-out folds and bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 2**32


def remainder(of: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo ``of``; 0 for a null doc_id."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return (F.crc32(text) % of).cast("int")


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) with one row per doc_id; repeated rows count once, the higher label wins, nulls are no labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return known.groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))


def sample(rows: DataFrame, count: int, most: int, seed: int = 1) -> DataFrame:
    """About ``most`` of ``count`` rows (all, if fewer), chosen by a hash of doc_id: the same rows on every run."""
    share = min(1.0, most / max(count, 1))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(SPAN)) < int(share * SPAN))


def sampled_texts(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Whole texts of a bounded sample: ``picked`` holds at most the documented number of rows, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
