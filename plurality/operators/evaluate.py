"""Scoring predictions against observed distributions, and the summaries of a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import dist
from plurality.operators.bootstrap import bootstrap_ci
from plurality.plans.skew import attach


def normalizers(cells: DataFrame) -> DataFrame:
    """Mean distance of the truth to uniform, per split and dataset.

    Build it from the full cell table, not from a sample, so that scores of samples compare.
    """
    distance = dist.tvd_to_uniform(dist.renorm(dist.align(F.col("truth"), F.col("options"))))
    return cells.groupBy("split", "dataset").agg(F.avg(distance).alias("z"))


def evaluate(cells: DataFrame, preds: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """One scored row per record and system.

    The denominator is the dataset-level ``z``; where the table of normalizers has no row
    for a (split, dataset) the record's own distance to uniform is used.
    """
    norms = normalizers(cells) if norms is None else norms
    truth = cells.select(
        "record_id",
        "dataset",
        "split",
        "question",
        F.size("options").alias("n_options"),
        ((F.col("n_grouping_vars") == 0) & (F.size("segment") == 0)).alias("is_population"),
        "segment",
        "grouping_keys",
        "group_size",
        "options",
        "truth",
        dist.renorm(dist.align(F.col("truth"), F.col("options"))).alias("p"),
        dist.map_entropy(F.col("truth")).alias("truth_entropy"),
    ).withColumn("tvd_u", dist.tvd_to_uniform(F.col("p")))
    rows = attach(truth, norms, ["split", "dataset"], ["record_id"]).join(preds, "record_id")
    scored = rows.withColumn("q", dist.renorm(dist.align(F.col("pred"), F.col("options"))))
    scored = scored.withColumn("tvd", dist.tvd(F.col("p"), F.col("q")))
    return scored.withColumn("score", dist.skill(F.col("tvd"), F.coalesce("z", "tvd_u")))


def paired_scores(scored: DataFrame, first: str, second: str) -> DataFrame:
    """Two systems side by side on the records both answered."""
    keep = ["record_id", "dataset", "split", "question", "segment", "tvd_u", "z", "score", "tvd"]
    left = scored.filter((F.col("system") == first) & F.col("pred").isNotNull()).select(*keep)
    right = scored.filter((F.col("system") == second) & F.col("pred").isNotNull()).select(
        "record_id", F.col("score").alias("score_b"), F.col("tvd").alias("tvd_b")
    )
    return left.join(right, "record_id").withColumn("delta", F.col("score_b") - F.col("score"))


def wide_scores(scored: DataFrame, systems: Sequence[str], value: str = "score") -> DataFrame:
    """One row per record with a column per system; a single shuffle for any number of systems."""
    picks = [F.max(F.when(F.col("system") == s, F.col(value))).alias(s) for s in systems]
    return scored.groupBy("record_id", "dataset", "split", "question").agg(*picks)


def headline(scored: DataFrame, groups: Sequence[str] = ("system",), n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """n, mean score with interval, and share of records below uniform level."""
    out = bootstrap_ci(scored, groups, "score", n_boot=n_boot, seed=seed)
    return out.withColumnRenamed("below_zero", "frac_below_uniform")


def score_by(scored: DataFrame, columns: Sequence[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Mean score, interval and n for each value of ``columns``, best first."""
    out = bootstrap_ci(scored, columns, "score", n_boot=n_boot, seed=seed).drop("below_zero")
    return out.orderBy(F.desc("mean"), *columns)


def split_stats(scored: DataFrame, groups: Sequence[str] = ("system",), n_boot: int = 2000) -> DataFrame:
    """Grouped mean with interval and half-width, population mean, pooled mean and split average."""
    parts = bootstrap_ci(scored, [*groups, "split"], "score", n_boot=n_boot)
    on = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    out = parts.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        on("grouped", "mean").alias("grouped"),
        on("pop", "mean").alias("pop"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("pooled"),
        on("grouped", "ci_low").alias("g_lo"),
        on("grouped", "ci_high").alias("g_hi"),
    )
    return out.withColumns(
        {
            "g_hw": (F.col("g_hi") - F.col("g_lo")) / 2,
            "split_avg": (F.col("grouped") + F.col("pop")) / 2,
        }
    )


def topline(scored: DataFrame, alignment: DataFrame | None = None, n_boot: int = 2000) -> DataFrame:
    """One row per system, best first; ``alignment`` adds the counterfactual column."""
    rows = headline(scored, ["system"], n_boot=n_boot)
    if alignment is not None:
        rows = rows.join(alignment, "system", "left")
    return rows.orderBy(F.desc("mean"), "system")


def in_order(rows: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Rows in a fixed order of systems; others follow by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in systems]), F.col("system"))
    return rows.orderBy(F.when(place > 0, place).otherwise(F.lit(len(systems) + 1)), "system")


def sweep(scored: DataFrame, model: Column, models: Sequence[str]) -> DataFrame:
    """Mean score, systems down and models across."""
    return scored.withColumn("_model", model).groupBy("system").pivot("_model", list(models)).agg(F.avg("score"))


def union_systems(*preds: DataFrame) -> DataFrame:
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return out
