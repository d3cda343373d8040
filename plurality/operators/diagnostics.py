"""Breakdowns of a scored table: entropy regimes, reliability, histograms, families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import dist
from plurality.functions.rounding import r6
from plurality.plans.ranking import quantiles
from plurality.plans.skew import with_totals

EDGE = 1e-9  # values this close below an edge count as on it, so float noise cannot move a row


def bin_of(value: Column, bins: int) -> Column:
    """1-based bin of [0, 1) in ``bins`` equal half-open bins; 1.0 falls outside as bin ``bins + 1``."""
    return (F.floor((value + EDGE) * bins) + 1).cast("int")


def entropy_thirds(scored: DataFrame) -> DataFrame:
    """Mean score by truth entropy in (.., .33], (.33, .66], (.66, 1]."""
    e = F.col("truth_entropy")
    third = F.when(e <= 0.33, "low").when(e <= 0.66, "mid").otherwise("high")
    return scored.groupBy("system", third.alias("third")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))


def entropy_tertiles(decomposed: DataFrame) -> DataFrame:
    """Mean score per system and tertile of the grouped truths' entropy; the edges are pooled over systems."""
    rows = decomposed.filter(F.col("split") == "grouped")
    edges = quantiles(rows, [], "truth_entropy", {"a": 1 / 3, "b": 2 / 3}).first()
    a, b = (edges["a"], edges["b"]) if edges else (0.0, 0.0)
    e = F.col("truth_entropy")
    regime = F.when(e <= a + EDGE, "low").when(e <= b + EDGE, "mid").otherwise("high")
    return (
        rows.withColumn("regime", regime)
        .groupBy("system")
        .pivot("regime", ["low", "mid", "high"])
        .agg(100 - F.avg("score_loss"))
    )


def entropy_curve(scored: DataFrame, bins: int = 8, min_count: int = 1) -> DataFrame:
    """Mean score over equal entropy bins; a truth entropy of exactly one has no bin."""
    rows = scored.withColumn("bin", bin_of(F.col("truth_entropy"), bins)).filter(F.col("bin") <= bins)
    out = rows.groupBy("system", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))
    return out.filter(F.col("n") >= min_count).withColumn("mid", (F.col("bin") - 0.5) / bins)


def reliability(scored: DataFrame, bins: int = 10, min_count: int = 1) -> DataFrame:
    """Mean predicted and observed probability of the option cells in each predicted-probability bin."""
    pairs = scored.select(
        "system",
        F.explode(
            F.arrays_zip(
                dist.align(F.col("pred"), F.col("options")).alias("q"),
                dist.align(F.col("truth"), F.col("options")).alias("p"),
            )
        ).alias("c"),
    ).select("system", "c.q", "c.p", bin_of(F.col("c.q"), bins).alias("bin"))
    out = (
        pairs.filter(F.col("bin") <= bins)
        .groupBy("system", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean_pred"), F.avg("p").alias("mean_truth"))
    )
    return out.filter(F.col("n") >= min_count)


def score_histogram(scored: DataFrame, floor: float = -100.0, bins: int = 40) -> DataFrame:
    """Counts of the clipped scores in ``bins`` equal bins between each system's smallest and largest value."""
    clipped = scored.select("system", "record_id", F.greatest(F.col("score"), F.lit(floor)).alias("s"))
    rows = with_totals(clipped, ["system"], [F.min("s").alias("lo"), F.max("s").alias("hi")], ["record_id"])
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    slot = F.floor((F.col("s") - F.col("lo")) / width * bins + EDGE)
    return rows.groupBy("system", F.least(F.lit(bins - 1), slot).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def score_histogram_wide(scored: DataFrame, step: int = 20, top: int = 100) -> DataFrame:
    """Counts per ``step``-wide bin from a data-derived floor up to ``top``; values outside go to the end bins."""
    low = scored.agg(F.least(F.lit(0.0), F.min("score")).alias("m")).first()["m"]
    lo = int(low // step) * step
    last = (top - lo) // step - 1
    slot = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col("score") - lo) / step + EDGE)))
    return scored.groupBy("system", (slot * step + lo).cast("int").alias("edge")).agg(F.count(F.lit(1)).alias("n"))


def pooled_questions(tagged: DataFrame) -> DataFrame:
    """Observed and predicted shares per rule and option, weighted by group size.

    One unknown size, or sizes that sum to nothing, gives every row of the rule weight one.
    """
    keys = ["rule", "system"]
    size = F.col("group_size").cast("double")
    flagged = with_totals(
        tagged,
        keys,
        [F.bool_or(size.isNull() | F.isnan(size)).alias("_odd"), F.sum(size).alias("_all")],
        ["record_id"],
    )
    weight = F.when(F.col("_odd") | (F.coalesce("_all", F.lit(0.0)) <= 0), F.lit(1.0)).otherwise(size)
    cellwise = flagged.select(*keys, weight.alias("w"), F.explode(F.arrays_zip("options", "p", "q")).alias("o"))
    sums = cellwise.groupBy(*keys, F.col("o.options").alias("option")).agg(
        F.sum(F.col("w") * F.col("o.p")).alias("p"), F.sum(F.col("w") * F.col("o.q")).alias("q")
    )
    both = with_totals(sums, keys, [F.sum("p").alias("_p"), F.sum("q").alias("_q")], ["option"])
    share = lambda c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0.0))).otherwise(F.col(c))
    return both.select(*keys, "option", share("p").alias("human"), share("q").alias("predicted"))


def mean_entropy(decomposed: DataFrame, groups: Sequence[str]) -> DataFrame:
    return decomposed.groupBy(*groups).agg(
        F.avg("truth_entropy").alias("human_entropy"), F.avg("pred_entropy").alias("pred_entropy")
    )


def dataset_split_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dataset").pivot("split", ["pop", "grouped"]).agg(F.count(F.lit(1))).na.fill(0)


def option_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.size("options").alias("n_options")).agg(F.count(F.lit(1)).alias("records"))


def entropy_profile(cells: DataFrame) -> DataFrame:
    """Mean and spread of the truth entropy per split, and the share above the population's upper tertile."""
    rows = cells.select("split", dist.map_entropy(F.col("truth")).alias("h"))
    edge = quantiles(rows.filter(F.col("split") == "pop"), [], "h", {"q": 2 / 3}).first()
    upper = edge["q"] if edge else 1.0
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("h").alias("mean"),
        F.stddev_samp("h").alias("std"),
        F.avg((F.col("h") + EDGE >= upper).cast("double")).alias("contested"),
    )


def entropy_histogram(cells: DataFrame, bins: int = 40) -> DataFrame:
    """Cells per split and equal entropy bin; an entropy of one counts in the last bin."""
    slot = F.least(F.lit(bins), bin_of(dist.map_entropy(F.col("truth")), bins))
    return cells.groupBy("split", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropy_extremes(cells: DataFrame, split: str = "pop", n: int = 3) -> DataFrame:
    """The ``n`` most agreed and the ``n`` most contested cells of a split, by rounded entropy then id."""
    rows = cells.filter(F.col("split") == split).select("record_id", r6(dist.map_entropy(F.col("truth"))).alias("h"))
    low = rows.orderBy("h", "record_id").limit(n).withColumn("end", F.lit("consensus"))
    high = rows.orderBy(F.desc("h"), "record_id").limit(n).withColumn("end", F.lit("contested"))
    return low.unionByName(high)


def family_entropy(cells: DataFrame) -> DataFrame:
    """Population entropy against the entropies of the question's groups, for families that have both."""
    h = cells.select("dataset", "question", "split", dist.map_entropy(F.col("truth")).alias("h"))
    group = F.when(F.col("split") == "grouped", F.col("h"))
    return (
        h.groupBy("dataset", "question")
        .agg(
            F.max(F.when(F.col("split") == "pop", F.col("h"))).alias("pop_entropy"),
            F.avg(group).alias("mean_group_entropy"),
            F.stddev_pop(group).alias("std_group_entropy"),
            (F.max(group) - F.min(group)).alias("entropy_range"),
            F.count(group).alias("n_groups"),
        )
        .filter(F.col("pop_entropy").isNotNull() & (F.col("n_groups") > 0))
    )


def family_entropy_by_dataset(families: DataFrame) -> DataFrame:
    return families.groupBy("dataset").agg(
        F.avg("n_groups").alias("mean_groups"),
        F.max("n_groups").alias("max_groups"),
        F.avg("entropy_range").alias("mean_range"),
        F.max("entropy_range").alias("max_range"),
    )


def mechanism_diagnostics(decomposed: DataFrame, consensus: float = 0.4, committed: float = 0.45) -> DataFrame:
    """Spread diagnostics on grouped records: level, floor and slope of the predicted entropy, commitment, mode accuracy."""
    rows = decomposed.filter(F.col("split") == "grouped")
    p, t = F.col("pred_entropy"), F.col("truth_entropy")
    stats = rows.groupBy("system").agg(
        F.avg(p).alias("pred_h"),
        F.regr_slope(p, t).alias("slope"),
        F.avg(F.when(t < consensus, (p < committed).cast("double"))).alias("commit_rate"),
        F.avg(F.col("mode_match").cast("double")).alias("mode_acc"),
    )
    return stats.join(quantiles(rows, ["system"], "pred_entropy", {"floor_p10": 0.1}), "system")
