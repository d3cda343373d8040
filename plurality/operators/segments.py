"""Demographic segments: weights of finer cells, and predictions rebuilt from them.

A cell's parents are its segment with one variable removed, so every link is an equi-join
key made from the child.  Nothing compares cells pairwise, and sums over a parent's cells
are partial aggregates, so a parent with very many cells stays spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import dist, keys
from plurality.plans.ranking import quantiles
from plurality.plans.skew import attach, one_row, with_share, with_totals

PARENT = ["dataset", "question", "parent_key"]

# Ideology scale used for panel weights (fixed values).
IDEOLOGY_BUCKETS = ("very liberal", "liberal", "moderate", "conservative", "very conservative")


def distribution_table(cells: DataFrame) -> DataFrame:
    """Share of every cell inside its (dataset, question, grouping variables) set."""
    rows = cells.withColumn("variables", F.array_join("grouping_keys", ","))
    size = F.coalesce(F.col("group_size"), F.lit(0)).cast("double")
    return with_share(rows, ["dataset", "question", "variables"], size, "weight", ["record_id"])


def grouping_counts(cells: DataFrame, top: int = 10) -> DataFrame:
    """Most common grouping-variable combinations."""
    counts = cells.groupBy(F.array_join("grouping_keys", ",").alias("variables")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "variables").limit(top)


def links(cells: DataFrame) -> DataFrame:
    """One row per cell and removable variable, keyed by the parent it would refine."""
    child = cells.withColumns(
        {"child_id": F.col("record_id"), "w": F.coalesce("group_size", F.lit(0)).cast("double")}
    )
    return child.withColumn("var", F.explode(F.map_keys("segment"))).withColumn(
        "parent_key", keys.segment_key(F.map_filter("segment", lambda k, _: k != F.col("var")))
    )


def _parents(cells: DataFrame) -> DataFrame:
    return cells.select("dataset", "question", keys.segment_key(F.col("segment")).alias("parent_key"), F.col("record_id").alias("parent_id"))


def child_weights(cells: DataFrame) -> DataFrame:
    """(parent_id, var, child_id, weight) with weights summing to one per parent and variable."""
    edges = links(cells).select(*PARENT, "var", "child_id", "w")
    shared = with_share(edges, [*PARENT, "var"], F.col("w"), "weight", ["child_id"])
    return shared.join(_parents(cells), PARENT).select("parent_id", "var", "child_id", "weight")


def decompositions(cells: DataFrame, min_cells: int = 2) -> DataFrame:
    """Per parent: variables with enough cells (sorted) and the best-covered variable."""
    per_var = links(cells).groupBy(*PARENT, "var").agg(F.sum("w").alias("covered"), F.count(F.lit(1)).alias("n"))
    per_parent = per_var.groupBy(*PARENT).agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") >= min_cells, F.col("var")))), ",").alias("variables"),
        F.min_by("var", F.struct((-F.col("covered")).alias("c"), "var")).alias("picked"),
    )
    return per_parent.join(_parents(cells), PARENT).select("parent_id", "variables", "picked")


def _mixed(chosen: DataFrame, preds: DataFrame, parent: Sequence[str]) -> DataFrame:
    """(parent, system, combined): share-weighted sum of the cells' predictions over the parent's options.

    ``chosen`` holds (parent, parent_options, record_id of a cell, share).  A label the cell lacks adds nothing.
    """
    values = F.arrays_zip(F.col("parent_options").alias("o"), dist.align(F.col("pred"), F.col("parent_options")).alias("q"))
    long = chosen.join(preds, "record_id").select(*parent, "system", "share", F.explode(values).alias("z"))
    sums = long.groupBy(*parent, "system", F.col("z.o").alias("option")).agg(F.sum(F.col("share") * F.col("z.q")).alias("v"))
    return sums.groupBy(*parent, "system").agg(F.map_from_entries(F.collect_list(F.struct("option", "v"))).alias("combined"))


def recombine(cells: DataFrame, preds: DataFrame, over: str | None = None, min_children: int = 2) -> DataFrame:
    """Predictions of parents as the share-weighted sum of their cells' predictions.

    The variable is chosen per parent, from the cells alone: without ``over`` the one whose cells cover most
    respondents (ties: variable name).  Parents where it has fewer than ``min_children`` cells are left
    out.  Returns (parent keys, system, combined) over the parent's own options, whatever the cells list.
    """
    edges = links(cells).select(*PARENT, "var", "w", F.col("child_id").alias("record_id"))
    if over is not None:
        edges = edges.filter(F.col("var") == over)
    per_var = edges.groupBy(*PARENT, "var").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    best = per_var.groupBy(*PARENT).agg(F.min_by(F.struct("var", "total", "n"), F.struct(-F.col("total"), F.col("var"))).alias("b"))
    parents = cells.select("dataset", "question", keys.segment_key(F.col("segment")).alias("parent_key"), F.col("options").alias("parent_options"))
    picked = best.filter(F.col("b.n") >= min_children).select(*PARENT, "b.*").join(parents, PARENT)
    share = F.when(F.col("total") > 0, F.col("w") / F.nullif(F.col("total"), F.lit(0.0))).otherwise(1.0 / F.col("n"))
    chosen = edges.join(picked, [*PARENT, "var"]).select(*PARENT, "parent_options", "record_id", share.alias("share"))
    return _mixed(chosen, preds, PARENT)


def post_stratify(cells: DataFrame, preds: DataFrame, over: str | None = None, min_children: int = 2) -> DataFrame:
    """Replace each prediction by the recombined one where its cells exist; ``decomposed`` tells which."""
    combined = recombine(cells, preds, over, min_children)
    own = preds.join(
        cells.select("record_id", "dataset", "question", "options", keys.segment_key(F.col("segment")).alias("parent_key")),
        "record_id",
    )
    both = own.join(combined, [*PARENT, "system"], "left")
    vector = dist.renorm(dist.align(F.col("combined"), F.col("options")))
    return both.select(
        "record_id",
        "system",
        F.when(F.col("combined").isNotNull(), dist.as_map(F.col("options"), vector)).otherwise(F.col("pred")).alias("pred"),
        F.col("combined").isNotNull().alias("decomposed"),
    )


def recombine_weighted(weights: DataFrame, cells: DataFrame, preds: DataFrame, min_children: int = 2) -> DataFrame:
    """Predictions of parents under any table of weights (parent_id, var, child_id, weight).

    The weights need not sum to one.  Per parent the variable with the largest total weight is used, of
    those with ``min_children`` cells or more (ties: variable name); parents without one are left out.
    """
    per_var = weights.groupBy("parent_id", "var").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    best = (
        per_var.filter(F.col("n") >= min_children)
        .groupBy("parent_id")
        .agg(F.min_by("var", F.struct(-F.col("total"), F.col("var"))).alias("var"))
        .join(cells.select(F.col("record_id").alias("parent_id"), F.col("options").alias("parent_options")), "parent_id")
    )
    chosen = weights.join(best, ["parent_id", "var"]).select("parent_id", "parent_options", F.col("child_id").alias("record_id"), F.col("weight").alias("share"))
    packed = _mixed(chosen, preds, ["parent_id"])
    labels = F.array_sort(F.map_keys("combined"))
    vector = dist.renorm(dist.align(F.col("combined"), labels))
    return packed.select(F.col("parent_id").alias("record_id"), "system", dist.as_map(labels, vector).alias("pred"))


def recombination_errors(cells: DataFrame, over: str | None = None) -> DataFrame:
    """Distance between each parent's truth and the share-weighted truths of its cells."""
    truths = cells.select("record_id", F.lit("truth").alias("system"), F.col("truth").alias("pred"))
    rebuilt = post_stratify(cells, truths, over).filter("decomposed").select("record_id", F.col("pred").alias("rebuilt"))
    rows = cells.join(rebuilt, "record_id")
    vec = lambda c: dist.renorm(dist.align(F.col(c), F.col("options")))
    return rows.select("record_id", "dataset", "grouping_keys", dist.tvd(vec("truth"), vec("rebuilt")).alias("tvd"))


def recombination_summary(cells: DataFrame, over: str | None = None) -> DataFrame:
    errors = recombination_errors(cells, over).select("tvd")
    stats = errors.agg(F.count(F.lit(1)).alias("n"), F.avg("tvd").alias("mean"), F.max("tvd").alias("max"))
    return one_row(stats, quantiles(errors, [], "tvd", {"median": 0.5}))


def segment_marginal(
    cells: DataFrame, axis: str, groups: Sequence[str] = (), vocabulary: Sequence[str] | None = None
) -> DataFrame:
    """Population share of each value of ``axis``, from cells grouped by that variable alone."""
    label = F.lower(F.trim(F.try_element_at("segment", F.lit(axis))))
    rows = cells.filter(F.col("grouping_keys") == F.array(F.lit(axis))).withColumn("label", label)
    if vocabulary is not None:
        rows = rows.filter(F.col("label").isin(*vocabulary))
    sizes = rows.groupBy(*groups, "label").agg(F.sum(F.coalesce("group_size", F.lit(0)).cast("double")).alias("size"))
    one = sizes.withColumn("_all", F.lit(1))
    totals = with_totals(one, [*groups, "_all"], [F.sum("size").alias("_total")], ["label"])
    return totals.filter(F.col("_total") > 0).select(*groups, "label", (F.col("size") / F.col("_total")).alias("share"))


def marginal_weights(panel: DataFrame, target: DataFrame, panel_keys: Sequence[str], member: str) -> DataFrame:
    """Weights that move each panel's label mix onto the target shares.

    Weight is target share over panel share of the member's label, scaled to sum to one;
    a panel without any targeted label gets equal weights.  Adds ``panel_share`` and ``weight``.
    """
    labels = panel.groupBy(*panel_keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    sizes = with_totals(labels, panel_keys, [F.sum("_n").alias("_members")], ["label"])
    per_label = sizes.select(*panel_keys, "label", (F.col("_n") / F.col("_members")).alias("panel_share"))
    per_label = per_label.join(target.select("label", "share"), "label", "left")
    rows = attach(panel, per_label, [*panel_keys, "label"], [member], "inner")
    ratio = F.coalesce(F.col("share"), F.lit(0.0)) / F.col("panel_share")
    return with_share(rows, panel_keys, ratio, "weight", [member]).drop("share")
