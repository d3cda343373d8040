"""Comparing systems on the same records: paired differences, ceilings, selectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.operators.bootstrap import bootstrap_ci
from plurality.operators.splits import folds
from plurality.plans.lineage import stored
from plurality.plans.skew import attach


def blocks(paired: DataFrame, n_boot: int = 2000) -> DataFrame:
    """Mean of both systems and of their difference, overall and per split, with an interval on the difference."""
    rows = paired.withColumn("block", F.explode(F.array(F.lit("overall"), F.col("split"))))
    out = bootstrap_ci(rows, ["block"], "delta", n_boot=n_boot, also=["score", "score_b"])
    return out.drop("below_zero").withColumnsRenamed(
        {"mean": "delta", "ci_low": "d_lo", "ci_high": "d_hi", "score": "first", "score_b": "second"}
    )


def confirmation(block_table: DataFrame) -> DataFrame:
    """Three rules: pooled gain above zero, and no significant loss on either split."""
    has = lambda b, ok: F.coalesce(F.bool_or((F.col("block") == b) & ok), F.lit(False))
    rules = block_table.agg(
        has("overall", F.col("d_lo") > 0).alias("pooled_gain"),
        has("grouped", F.col("d_hi") >= 0).alias("grouped_safe"),
        has("pop", F.col("d_hi") >= 0).alias("pop_safe"),
    )
    return rules.withColumn("confirmed", F.col("pooled_gain") & F.col("grouped_safe") & F.col("pop_safe"))


def noise_floor(stats: DataFrame, incumbent: str) -> DataFrame:
    """Grouped gap of every system to the incumbent against the larger half-width of the two."""
    everything = Window.partitionBy(F.lit(0))  # one summary row per system
    own = F.col("system") == incumbent
    of_base = lambda c: F.max(F.when(own, F.col(c))).over(everything)
    rows = stats.select("*", of_base("grouped").alias("_g"), of_base("g_hw").alias("_hw")).filter(~own)
    gap = F.col("grouped") - F.col("_g")
    floor = F.greatest(F.coalesce("g_hw", F.lit(0.0)), F.coalesce("_hw", F.lit(0.0)))
    verdict = F.when(gap > floor, "beats").when(gap > -floor, "ties").otherwise("loses")
    return rows.select("system", gap.alias("gap"), floor.alias("floor"), verdict.alias("verdict"))


def score_correlation(paired: DataFrame) -> DataFrame:
    return paired.agg(F.count(F.lit(1)).alias("n"), F.corr("score", "score_b").alias("corr"))


def by_kind(paired: DataFrame, kind: Column, routes: Mapping[str, str], default: str) -> DataFrame:
    """Scores of both systems per task kind, with the route taken for that kind."""
    table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    means = paired.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("first"),
        F.avg("score_b").alias("second"),
        F.avg("delta").alias("delta"),
    )
    return means.withColumn("route", F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(default)))


def mechanism(decomposed: DataFrame, first: str, second: str) -> DataFrame:
    """Mean facets of two systems side by side, one row per facet."""
    facets = {
        "pred_entropy": F.col("pred_entropy"),
        "truth_entropy": F.col("truth_entropy"),
        "concentration_err": F.col("conc"),
        "location_err": F.col("loc"),
        "mode_mass_err": F.col("mode_mass_err"),
        "abs_entropy_gap": F.abs("entropy_gap"),
        "mode_match_rate": F.col("mode_match").cast("double"),
    }
    rows = decomposed.filter(F.col("system").isin(first, second))
    long = rows.select(
        "system", F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("v")) for n, c in facets.items()])).alias("f")
    )
    return long.groupBy("f.facet").pivot("system", [first, second]).agg(F.avg("f.v"))


def oracle_ceiling(wide: DataFrame, model: str, uniform: str = "uniform") -> DataFrame:
    """Abstention learned on one half of each dataset and applied to the other, against the per-record best.

    Datasets whose fit-half mean is below zero predict uniform on the eval half.
    """
    halves = stored(folds(wide).select("record_id", "dataset", model, uniform, "first_half"), "folds")  # ranked once, read twice
    m, u = F.col(model), F.col(uniform)
    flagged = (
        halves.filter("first_half").groupBy("dataset").agg((F.avg(m) < 0).alias("_abstain"))
    )
    rows = attach(halves.filter(~F.col("first_half")), flagged, ["dataset"], ["record_id"])
    chosen = F.when(F.col("_abstain"), u).otherwise(m)
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(m).alias("model"),
        F.avg(chosen).alias("abstain"),
        F.avg(F.greatest(m, u)).alias("oracle"),
    )
    room = F.col("oracle") - F.col("model")
    return out.withColumn(
        "captured", F.when(room > 0, (F.col("abstain") - F.col("model")) / F.when(room > 0, room))
    )


def dataset_oracle(wide: DataFrame, base: str, other: str, routed: str, uniform: str = "uniform") -> DataFrame:
    """Per-dataset best of two systems and the uniform floor under the routed one, by split and overall.

    Choices are made on dataset means, so only (dataset, split) sums are combined.
    """
    cols = (base, other, routed, uniform)
    parts = wide.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in cols])
    whole = parts.groupBy("dataset").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    rows = parts.join(whole, "dataset")
    floor = F.when(F.col(f"_{routed}") < F.col(f"_{uniform}"), F.col(uniform)).otherwise(F.col(routed))
    best = F.when(F.col(f"_{other}") > F.col(f"_{base}"), F.col(other)).otherwise(F.col(base))
    rows = rows.withColumns({"floor": floor, "best": best, "block": F.explode(F.array(F.lit("overall"), F.col("split")))})
    return rows.groupBy("block").agg(
        F.sum("n").alias("n"),
        *[(F.sum(c) / F.sum("n")).alias(a) for c, a in ((base, "base"), (routed, "routed"), ("floor", "floor"), ("best", "oracle"))],
    )


def two_fold_select(wide: DataFrame, first: str, second: str, n_boot: int = 2000) -> DataFrame:
    """Choose the better system per dataset on one fold, score the choice on the other, both ways."""
    rows = stored(folds(wide).select("record_id", "dataset", first, second, "fold"), "folds")  # ranked once, read twice
    fit = rows.groupBy("dataset", "fold").agg((F.avg(second) > F.avg(first)).alias("use_second"))
    decisions = fit.select("dataset", (1 - F.col("fold")).cast("int").alias("fold"), "use_second")
    picked = attach(rows, decisions, ["dataset", "fold"], ["record_id"])
    chosen = F.when(F.coalesce("use_second", F.lit(False)), F.col(second)).otherwise(F.col(first))
    scored = picked.withColumn("selected", chosen).withColumn("gain", F.col("selected") - F.col(first))
    scored = scored.withColumns({"_a": F.col(first), "_b": F.col(second)})
    out = bootstrap_ci(scored, [], "gain", n_boot=n_boot, also=["_a", "_b", "selected"]).drop("below_zero")
    return out.withColumnsRenamed({"mean": "gain", "ci_low": "g_lo", "ci_high": "g_hi", "_a": "first", "_b": "second"})


def fold_choices(wide: DataFrame, first: str, second: str) -> DataFrame:
    """Which system each fold chose per dataset."""
    return (
        folds(wide)
        .groupBy("dataset", "fold")
        .agg(F.when(F.avg(second) > F.avg(first), second).otherwise(first).alias("choice"))
    )
