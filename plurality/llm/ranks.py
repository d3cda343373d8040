"""Gapless positions in pseudorandom order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 10


def gapless(df: DataFrame, keys: Sequence[str], order: str, name: str, ties: Sequence[Column] = (), bits: int = BIN_BITS) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... inside each group of ``keys``, in the order of the long hash ``order``.

    A group is cut into 2^bits bins of the hash.  Rows are numbered inside (group, bin) and shifted by
    the rows in the earlier bins, so a group that holds most rows is still spread over many tasks.
    ``df`` is read twice: give a cheap or stored one.  ``keys`` must not hold nulls.
    """
    keys = list(keys)
    rows = df.withColumn("_bin", F.shiftrightunsigned(order, 64 - bits))
    counts = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(order, *ties)
    return (
        rows.join(starts, [*keys, "_bin"])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_start"))
        .drop("_bin", "_start")
    )
