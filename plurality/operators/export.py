"""Consolidated per-question export: the cell, its bucket and normalizer, and two systems."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import dist, keys
from plurality.functions.rounding import r6
from plurality.operators.evaluate import normalizers
from plurality.operators.splits import first_rule
from plurality.plans.skew import attach


def with_kind(rows: DataFrame, kinds: DataFrame, default: str = "other") -> DataFrame:
    """Add ``kind`` from a table (dataset, kind) of any size; datasets it lacks get the default."""
    found = attach(rows, kinds.dropDuplicates(["dataset"]), ["dataset"], ["record_id"])
    return found.withColumn("kind", F.coalesce("kind", F.lit(default)))


def kind_of(dataset: Column, kinds: Mapping[str, str], default: str = "other") -> Column:
    """Dataset to task kind through a small literal map."""
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, dataset), F.lit(default))


def rounded_json(d: Column) -> Column:
    return F.to_json(F.transform_values(d, lambda _, v: F.round(v, 6)))


def question_export(
    split_cells: DataFrame,
    preds: DataFrame,
    ours: str,
    base: str,
    kinds: Mapping[str, str],
    rules: Mapping[str, str],
    norms: DataFrame | None = None,
) -> DataFrame:
    """One wide row per cell that both systems answered."""
    norms = normalizers(split_cells) if norms is None else norms
    answers = (
        preds.filter(F.col("system").isin(ours, base))
        .groupBy("record_id")
        .agg(*[F.first(F.when(F.col("system") == s, F.col("pred")), ignorenulls=True).alias(n) for s, n in ((ours, "_o"), (base, "_b"))])
        .filter(F.col("_o").isNotNull() & F.col("_b").isNotNull())
    )
    rows = attach(split_cells, norms, ["split", "dataset"], ["record_id"]).join(answers, "record_id")
    rows = rows.withColumns(
        {
            "_p": dist.renorm(dist.align(F.col("truth"), F.col("options"))),
            "_qo": dist.renorm(dist.align(F.col("_o"), F.col("options"))),
            "_qb": dist.renorm(dist.align(F.col("_b"), F.col("options"))),
        }
    )
    rows = rows.withColumn("_u", dist.tvd_to_uniform(F.col("_p")))
    z = F.coalesce("z", "_u")
    rows = rows.withColumns(
        {
            "_so": dist.skill(dist.tvd(F.col("_p"), F.col("_qo")), z),
            "_sb": dist.skill(dist.tvd(F.col("_p"), F.col("_qb")), z),
            "_su": dist.skill(F.col("_u"), z),
        }
    )
    return rows.select(
        keys.question_id(F.col("dataset"), F.col("split"), F.col("question"), F.col("segment")).alias("question_id"),
        "dataset",
        kind_of(F.col("dataset"), kinds).alias("task_kind"),
        F.col("bucket").alias("eval_bucket"),
        "split",
        ((F.col("n_grouping_vars") == 0) & (F.size("segment") == 0)).alias("is_population"),
        F.col("n_grouping_vars").alias("num_segment_vars"),
        F.array_join("grouping_keys", "|").alias("segment_vars"),
        F.to_json("segment").alias("segment"),
        F.size("options").alias("n_options"),
        "group_size",
        first_rule(F.col("question"), rules).alias("required_question"),
        F.col("question").alias("question_text"),
        F.to_json("options").alias("options"),
        rounded_json(F.col("truth")).alias("human_dist"),
        r6(dist.entropy(F.col("_p"))).alias("truth_entropy"),
        r6("_u").alias("tvd_to_uniform"),
        r6("z").alias("normalizer_z"),
        r6("_su").alias("uniform_score"),
        F.lit(ours).alias("our_system"),
        rounded_json(F.col("_o")).alias("our_pred"),
        r6("_so").alias("our_score"),
        rounded_json(F.col("_b")).alias("base_pred"),
        r6("_sb").alias("base_score"),
        r6(F.col("_so") - F.col("_sb")).alias("lift"),
    )
