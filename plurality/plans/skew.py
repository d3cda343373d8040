"""Joins that attach one row per key to many rows per key without hot partitions.

A key may own a third of all rows.  The per-key side is small, so it is copied once per
salt and the many-rows side spreads each key over the salts by a deterministic hash
(a retried task sends its rows to the same place).  Because the salted side is shuffled for
the join itself, adaptive execution can also split a slice that is still too large.  Use it where the keys are
few beside the rows; where there are about as many keys as rows (records, parents, stems, questions) a plain
join moves each side once, and adaptive execution splits a partition that a hot key makes too large.  No
broadcast hint is given: the join becomes a broadcast join only when the measured size
of the per-key side allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS_CONF = "spark.plurality.join.salts"


def salts(df: DataFrame) -> int:
    """Slices a hot key is cut into: set by configuration, else grown with the cluster from 8 to 64."""
    spark = df.sparkSession
    chosen = spark.conf.get(SALTS_CONF, None)
    return int(chosen) if chosen else max(8, min(64, spark.sparkContext.defaultParallelism // 16))


def attach(
    many: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join ``per_key`` (one row per ``keys``) to ``many``; ``spread`` columns feed the salt."""
    n = salts(many)
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(n)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_totals(
    df: DataFrame, keys: Sequence[str], totals: Sequence[Column], spread: Sequence[str]
) -> DataFrame:
    """Add per-group totals to every row: partial aggregation, then a salted join.

    A window ``sum() over (partition by keys)`` would gather a hot group in one task.
    """
    return attach(df, df.groupBy(*keys).agg(*totals), keys, spread, "inner")


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row tables side by side, by union and aggregation instead of a join without a key."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def with_share(
    df: DataFrame, keys: Sequence[str], weight: Column, name: str, spread: Sequence[str]
) -> DataFrame:
    """Share of ``weight`` inside each group; equal shares when the group total is not positive."""
    rows = with_totals(
        df.withColumn("_w", weight), keys, [F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_rows")], spread
    )
    share = F.when(F.col("_total") > 0, F.col("_w") / F.when(F.col("_total") > 0, F.col("_total"))).otherwise(
        F.lit(1.0) / F.col("_rows")
    )
    return rows.withColumn(name, share).drop("_w", "_total", "_rows")
