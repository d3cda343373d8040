"""Experiment logs: paths and trees, best-so-far, the gate replay, costs.

A log row is one node of a run: run_id, seq, node_id, parent_id, lever_id, config_hash,
dev_score, val_score, cost_usd.  Nothing here bounds the length or depth of a run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.operators import gate, tour
from plurality.plans.lineage import cut, stored
from plurality.plans.skew import attach

STRETCH = 4096  # nodes of a run handled together by the running totals


def with_paths(log: DataFrame) -> DataFrame:
    """Add ``path`` (root to node), ``lever_path``, ``sort_path`` (seq along it) and ``depth``.

    Every round joins each open pointer to the ancestor it names and takes over that
    ancestor's pointer, so the covered depth doubles: a tree of depth d needs log2(d) rounds.  Parents that lead in
    a circle never end; they show as more rounds than a tree of all nodes could need, and raise.
    """
    rounds = max(1, log.count()).bit_length() + 1
    tracks = {"path": "node_id", "lever_path": "lever_id", "sort_path": "seq"}
    state = log.select("run_id", "node_id", F.col("parent_id").alias("up"), *[F.array(c).alias(t) for t, c in tracks.items()])
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        if rounds == 0:
            raise ValueError("the parents of some nodes lead in a circle")
        rounds -= 1
        above = state.select(
            "run_id",
            F.col("node_id").alias("up"),
            F.col("up").alias("_next"),
            *[F.col(t).alias(f"_{t}") for t in tracks],
        )
        joined = state.join(above, ["run_id", "up"], "left")
        state = cut(
            joined.select(
                "run_id",
                "node_id",
                F.col("_next").alias("up"),
                *[F.when(F.col(f"_{t}").isNull(), F.col(t)).otherwise(F.concat(f"_{t}", t)).alias(t) for t in tracks],
            )
        )
    out = log.join(state.drop("up"), ["run_id", "node_id"])
    return out.withColumn("depth", F.size("path") - 1)


def _running(log: DataFrame, totals: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Running ``sum`` or ``max`` before and up to each node, by stretches of about ``STRETCH`` nodes.

    Stretches are ranges of (run, seq) of equal row counts, however ``seq`` is spread.  Inside a stretch a
    window runs; between stretches only one total per stretch is scanned.
    """
    parts = max(1, log.count() // STRETCH)
    rows = stored(log.repartitionByRange(parts, "run_id", "seq").withColumn("_stretch", F.spark_partition_id()), "stretches")
    for name, (value, _) in totals.items():
        rows = rows.withColumn(f"_{name}", value)
    fold = {"sum": F.sum, "max": F.max}
    per = rows.groupBy("run_id", "_stretch").agg(*[fold[how](f"_{n}").alias(f"_t_{n}") for n, (_, how) in totals.items()])
    earlier = Window.partitionBy("run_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("run_id", "_stretch", *[fold[how](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (_, how) in totals.items()])
    inside = Window.partitionBy("run_id", "_stretch").orderBy("seq")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(carried, ["run_id", "_stretch"])
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), "max": lambda a, b: F.greatest(a, b)}
    for n, (_, how) in totals.items():
        rows = rows.withColumns(
            {
                n: join[how](fold[how](f"_{n}").over(upto), F.col(f"_c_{n}")),
                f"{n}_before": join[how](fold[how](f"_{n}").over(before), F.col(f"_c_{n}")),
            }
        )
    return rows.drop("_stretch", *[f"_{n}" for n in totals], *[f"_c_{n}" for n in totals])


def progression(log: DataFrame) -> DataFrame:
    """Scored nodes in order with the best value so far and whether this one set it."""
    rows = _running(log.filter(F.col("val_score").isNotNull()), {"best": (F.col("val_score"), "max"), "step": (F.lit(1.0), "sum")})
    new = F.col("best_before").isNull() | (F.col("val_score") > F.col("best_before"))
    return rows.select(
        "run_id", F.col("step").cast("bigint").alias("step"), "node_id", "lever_id", "val_score", F.col("best").alias("best_so_far"), new.alias("is_new_best")
    )


def running_cost(log: DataFrame) -> DataFrame:
    return _running(log, {"cum": (F.col("cost_usd"), "sum")}).select(
        "run_id", "seq", "node_id", "cost_usd", F.col("cum").alias("cum_cost_usd")
    )


def gate_replay(log: DataFrame, eta: Column) -> DataFrame:
    """Nodes the gate accepts: score above the last accepted one by more than ``eta`` (>= 0).

    An accepted score is higher than every score before it, so only record highs can be accepted.  ``gate`` replays
    their stretches in parallel.
    """
    return gate.accepted(progression(log).filter("is_new_best"), eta)


def config_lookup(log: DataFrame) -> DataFrame:
    """The node that answers for each configuration: its first scored node, else its first node."""
    first = F.min_by(F.struct("node_id", "val_score", "seq"), F.struct(F.col("val_score").isNull(), "seq"))
    return log.groupBy("run_id", "config_hash").agg(first.alias("n")).select("run_id", "config_hash", "n.node_id", "n.val_score")


def log_summary(log: DataFrame) -> DataFrame:
    """Total cost, distinct scored configurations and best value per run."""
    scored = F.col("val_score").isNotNull()
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum("cost_usd").alias("total_cost"),
        F.count_distinct(F.when(scored, F.col("config_hash"))).alias("global_k"),
        F.max("val_score").alias("best_val"),
    )


def tree_lines(log: DataFrame) -> DataFrame:
    """Indented listing; order by run and ``place`` to print it."""
    rows = tour.intervals(log)
    mark = F.when(F.col("val_score").isNull(), "·").when(F.coalesce("accepted", F.lit(False)), "✓").otherwise("✗")
    val = F.when(F.col("val_score").isNull(), F.lit("")).otherwise(F.format_string(" val=%.2f", "val_score"))
    cost = F.when(F.coalesce("cost_usd", F.lit(0.0)) != 0, F.format_string(" $%.2f", "cost_usd")).otherwise(F.lit(""))
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth")), mark, F.lit(" "), "lever_id", F.format_string(" (dev=%.2f", "dev_score"), val, F.lit(")"), cost
    )
    return rows.select("run_id", "node_id", F.col("begin").alias("place"), line.alias("line"))


def subtree_totals(log: DataFrame) -> DataFrame:
    """Nodes and cost of each node with all below it: differences of one running total in pre-order."""
    placed = stored(tour.intervals(log).select("run_id", "node_id", "begin", "end", "depth", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")), "placed")
    running = stored(_running(placed.withColumnRenamed("begin", "seq"), {"cum": (F.col("cost_usd"), "sum")}), "running")
    upto = running.select("run_id", (F.col("seq") + 1).alias("end"), F.col("cum").alias("total"))
    return running.join(upto, ["run_id", "end"]).select(
        "run_id", "node_id", "depth", (F.col("end") - F.col("seq")).alias("nodes"), (F.col("total") - F.coalesce("cum_before", F.lit(0.0))).alias("cost_usd")
    )


def node_reports(log: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (run_id, node_id; few per run) with the levers that led to each, root first."""
    placed = stored(tour.intervals(log).select("run_id", "node_id", "lever_id", "begin", "end", "depth"), "placed")
    wanted = placed.join(targets.select("run_id", "node_id"), ["run_id", "node_id"]).select("run_id", F.col("node_id").alias("target"), F.col("begin").alias("at"))
    steps = F.array_sort(F.collect_list(F.struct("depth", "node_id", "lever_id")))
    found = tour.ancestors(placed, wanted).groupBy("run_id", "target").agg(steps.alias("steps"))
    return log.join(
        found.select("run_id", F.col("target").alias("node_id"), F.col("steps.node_id").alias("path"), F.col("steps.lever_id").alias("lever_path"), (F.size("steps") - 1).alias("depth")), ["run_id", "node_id"]
    )


def node_report(log: DataFrame, run_id: str, node_id: str) -> DataFrame:
    """One node with the levers that led to it."""
    own = log.filter(F.col("run_id") == run_id)
    return node_reports(own, own.filter(F.col("node_id") == node_id))


def replay(log: DataFrame) -> DataFrame:
    """Recorded steps in order; ``position`` says it also where the rows are stored or shuffled again."""
    placed = _running(log, {"position": (F.lit(1.0), "sum")})
    return placed.select("run_id", "seq", F.col("position").cast("bigint").alias("position"), "lever_id", "params", "rationale").orderBy("run_id", "seq")


def search_band(mean: Column, n: Column, k: Column, multiplier: float = 1.0) -> tuple[Column, Column]:
    """Band around a mean that widens with the number of configurations tried."""
    n, k = F.greatest(n, F.lit(1)).cast("double"), F.greatest(k, F.lit(1)).cast("double")
    half = multiplier * F.pow(F.ln(k * n) / n, F.lit(1.0 / 3.0)) * 100.0
    return mean - half, mean + half


def distinct_so_far(log: DataFrame) -> DataFrame:
    """Distinct scored configurations of a run up to each node (``k``): first occurrences per configuration, then their running count."""
    scored = log.filter(F.col("val_score").isNotNull())
    first = scored.groupBy("run_id", "config_hash").agg(F.min("seq").alias("seq")).select("run_id", "seq", F.lit(1.0).alias("_new"))
    placed = log.join(first, ["run_id", "seq"], "left").withColumn("_new", F.coalesce("_new", F.lit(0.0)))
    return _running(placed, {"k": (F.col("_new"), "sum")}).drop("_new", "k_before").withColumn("k", F.col("k").cast("bigint"))


def band_progression(log: DataFrame, means: DataFrame, systems: Sequence[str], multiplier: float = 1.0) -> DataFrame:
    """The band of each of ``systems`` after each node of each run.  ``means`` has one row per system: system, mean, n."""
    rows = distinct_so_far(log).select("run_id", "seq", "node_id", "k", F.explode(F.array(*[F.lit(s) for s in systems])).alias("system"))
    rows = attach(rows, means.select("system", "mean", "n"), ["system"], ["run_id", "seq"], "inner")
    low, high = search_band(F.col("mean"), F.col("n"), F.col("k"), multiplier)
    return rows.select("run_id", "seq", "node_id", "system", "k", "n", "mean", low.alias("low"), high.alias("high"))


# -- usage -------------------------------------------------------------------------


def cost(prices: Mapping[str, tuple[float, float]]) -> Column:
    """Native cost where recorded, else tokens times the model's price per million, else zero."""
    table = F.create_map(
        *[x for m, (i, o) in prices.items() for x in (F.lit(m), F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")))]
    )
    price = F.try_element_at(table, F.col("model"))
    estimate = F.col("prompt_tokens") / 1e6 * price["i"] + F.col("completion_tokens") / 1e6 * price["o"]
    return F.coalesce(F.col("cost"), estimate, F.lit(0.0))


def usage_totals(usage: DataFrame, prices: Mapping[str, tuple[float, float]] | DataFrame) -> DataFrame:
    """Calls, stored hits, tokens and cost per model.

    ``prices`` is a small dict or a table (model, input_price, output_price), per million tokens.
    """
    if isinstance(prices, DataFrame):
        listed = usage.join(prices.dropDuplicates(["model"]), "model", "left")
        estimate = F.col("prompt_tokens") / 1e6 * F.col("input_price") + F.col("completion_tokens") / 1e6 * F.col("output_price")
        rows = listed.withColumn("_usd", F.coalesce(F.col("cost"), estimate, F.lit(0.0)))
    else:
        rows = usage.withColumn("_usd", cost(prices))
    return rows.groupBy("model").agg(
        F.count_if(~F.col("cached")).alias("calls"),
        F.count_if("cached").alias("cache_hits"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.sum("_usd").alias("cost_usd"),
    )
