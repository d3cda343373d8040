"""Ranks, top-k and exact quantiles that never gather a hot group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.plans.skew import salts


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    spread: Sequence[str],
    rank: str | None = None,
) -> DataFrame:
    """First ``k`` rows of each group: first inside salted slices, then among the slice winners."""
    slices = Window.partitionBy(*keys, "_slice").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = (
        df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(salts(df))))
        .withColumn("_rank", F.row_number().over(slices))
        .filter(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= k)
        .drop("_slice")
    )
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def first_distinct(df: DataFrame, keys: Sequence[str], value: str, k: int, spread: Sequence[str]) -> DataFrame:
    """First ``k`` distinct values of each group in order.

    Map tasks drop everything past their own first ``k`` values before anything is shuffled,
    so long texts that cannot be among the first are never moved.
    """
    slices = Window.partitionBy(*keys, "_slice").orderBy(value)
    near = (
        df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(salts(df))))
        .select(*keys, value, "_slice")
        .withColumn("_rank", F.dense_rank().over(slices))
        .filter(F.col("_rank") <= k)
        .select(*keys, value)
        .distinct()
    )
    return top_per_group(near, keys, [F.col(value)], k, [value])


def ranked_by_hash(
    df: DataFrame, keys: Sequence[str], hash_hex: str, rank: str = "rank", total: str | None = None, digits: int = 3
) -> DataFrame:
    """Exact row number inside each group in the order of a hex hash column.

    Rows are numbered inside (group, hash prefix) and shifted by the running count of the
    earlier prefixes, so a group of any size is spread over 16^digits tasks.
    """
    keys = list(keys)
    rows = df.withColumn("_prefix", F.substring(hash_hex, 1, digits))
    counts = rows.groupBy(*keys, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_prefix",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(by_group).alias("_all"),
    )
    inside = Window.partitionBy(*keys, "_prefix").orderBy(hash_hex)
    out = (
        rows.join(offsets, [*keys, "_prefix"])
        .withColumn(rank, F.row_number().over(inside) + F.col("_offset"))
        .drop("_prefix", "_offset")
    )
    return out.withColumnRenamed("_all", total) if total else out.drop("_all")


def cumulative_counts(
    df: DataFrame, keys: list[str], value: str, lo: float = 0.0, hi: float = 1.0, bins: int = 4096
) -> DataFrame:
    """(keys, value, start, end, total): ranks [start, end) of every distinct value in its group.

    Equal values collapse in the partial aggregation; running sums are taken over bin
    totals and inside bins, so no task sees a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    slot = F.floor((F.col(value) - lo) / (hi - lo) * bins)
    counts = counts.withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), slot)))
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_binned"))
        .select(
            *keys,
            "_bin",
            F.coalesce(F.sum("_binned").over(before), F.lit(0)).alias("_offset"),
            F.sum("_binned").over(by_group).alias("_all"),
        )
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(offsets, [*keys, "_bin"])
        .withColumn("end", F.col("_offset") + F.sum("_c").over(inside))
        .select(*keys, value, (F.col("end") - F.col("_c")).alias("start"), "end", F.col("_all").alias("total"))
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    lo: float = 0.0,
    hi: float = 1.0,
    bins: int = 4096,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one output column per entry of ``probs``.

    ``lo``/``hi`` only steer how evenly the values spread over the bins; values outside
    fall into the edge bins and the result stays exact.
    """
    keys = list(keys)
    cum = cumulative_counts(df, keys, value, lo, hi, bins)
    picks = []
    for i, prob in enumerate(probs.values()):
        pos = F.lit(float(prob)) * (F.col("total") - 1)
        for side, index in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            hit = (F.col("start") <= index) & (index < F.col("end"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
    found = cum.groupBy(*keys).agg(F.max("total").alias("_all"), *picks)
    out = []
    for i, (name, prob) in enumerate(probs.items()):
        pos = F.lit(float(prob)) * (F.col("_all") - 1)
        out.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *out)


def gapless(lined: DataFrame) -> DataFrame:
    """``at`` (partition and place in it) made a gapless number; one count per partition reaches the driver."""
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["n"]) for r in lined.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, start = [], 0
    for number, n in counts:
        starts.append((number, start))
        start += n
    first = lined.sparkSession.createDataFrame(starts, "part long, start long")
    return lined.withColumn("part", part).join(first, "part").withColumn("at", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "start")
