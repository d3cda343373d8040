"""Trees of run logs by Euler tour and list ranking.

Every node is entered and left once.  What comes next on the tour is known locally: the first child or the leaving, the next sibling or
the leaving of the parent.  Pointer jumping along these links adds up, for every step at once, the nodes entered and the depth
gained on the rest of the tour; that numbers the nodes in pre-order.  The descendants of a node are then the numbers in
[begin, end), whatever the depth, and a listing is a sort by one number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.plans.lineage import stored
from plurality.plans.ranking import gapless

#: Links followed per round; the reach grows by one more than that many times.
JUMPS = 3
ROWS = 1_000_000


def _lined(log: DataFrame) -> DataFrame:
    """(at, run_id, node_id, up, above): nodes numbered with siblings in order of seq as neighbours; ``above`` is the parent's number."""
    base = log.select("run_id", "node_id", "parent_id", "seq")
    known = base.select("run_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    settled = base.join(known, ["run_id", "parent_id"], "left").select("run_id", "node_id", "seq", F.when(F.col("known"), F.col("parent_id")).alias("up"))
    order = ["run_id", "up", "seq", "node_id"]
    settled = stored(settled, "settled")
    parts = max(1, settled.count() // ROWS)
    lined = stored(settled.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "siblings")
    lined = stored(gapless(lined).select("at", "run_id", "node_id", "up"), "siblings")
    parents = lined.select("run_id", F.col("node_id").alias("up"), F.col("at").alias("above"))
    return stored(lined.join(parents, ["run_id", "up"], "left").select("at", "run_id", "node_id", "above"), "lined")


def _steps(lined: DataFrame) -> DataFrame:
    """(step, next, entered, gained) of the tours; step 2 * at enters a node, 2 * at + 1 leaves it.  The trees of a run are one list."""
    children = lined.filter("above IS NOT NULL").groupBy(F.col("above").alias("parent")).agg(F.min("at").alias("child")).select(F.col("parent").alias("at"), "child")
    after = lined.select((F.col("at") - 1).alias("at"), F.col("run_id").alias("next_run"), F.col("above").alias("next_above"), F.lit(True).alias("some"))
    rows = lined.join(children, "at", "left").join(after, "at", "left")
    sibling = F.coalesce("some", F.lit(False)) & (F.col("run_id") == F.col("next_run")) & F.col("above").eqNullSafe(F.col("next_above"))
    enter = F.struct((2 * F.col("at")).alias("step"), F.coalesce(2 * F.col("child"), 2 * F.col("at") + 1).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("gained"))
    leave = F.struct((2 * F.col("at") + 1).alias("step"), F.when(sibling, 2 * F.col("at") + 2).otherwise(2 * F.col("above") + 1).alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("gained"))
    return rows.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*")


def _ranked(steps: DataFrame, longest: int) -> DataFrame:
    """``steps`` with what the rest of the list adds up to; lists hold at most ``longest`` steps."""
    state, reach = stored(steps, "steps"), 1
    while reach < longest:
        ahead = state.select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("entered").alias("_entered"), F.col("gained").alias("_gained"))
        moved = state
        for _ in range(JUMPS):
            moved = moved.join(ahead, "next", "left").select(
                "step", F.col("_next").alias("next"), (F.col("entered") + F.coalesce("_entered", F.lit(0))).alias("entered"), (F.col("gained") + F.coalesce("_gained", F.lit(0))).alias("gained")
            )
        state, reach = stored(moved, "steps"), reach * (JUMPS + 1)
    if not state.filter("next IS NOT NULL").isEmpty():
        raise ValueError("the parents of some nodes lead in a circle")
    return state


def intervals(log: DataFrame) -> DataFrame:
    """``log`` with ``begin``, ``end`` and ``depth``: the nodes of a run numbered from 0 in pre-order, siblings by seq, then node_id.

    A node and all below it have the numbers begin, ..., end - 1.  Trees of one run follow each other by the seq of their roots.  A parent that the run does not
    hold makes a root; parents in a circle raise.  (run_id, node_id) names a row.
    """
    lined = _lined(log)
    sizes = stored(lined.groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes")), "sizes")
    longest = 2 * (sizes.agg(F.max("nodes")).first()[0] or 0)
    ranked = _ranked(_steps(lined), longest)
    node = F.floor(F.col("step") / 2).alias("at")
    entering = F.col("step") % 2 == 0
    rest = ranked.groupBy(node).agg(
        F.max(F.when(entering, F.col("entered"))).alias("from_begin"), F.max(F.when(~entering, F.col("entered"))).alias("from_end"), F.max(F.when(entering, -F.col("gained"))).alias("depth")
    )
    placed = lined.join(rest, "at").join(sizes, "run_id").select(
        "run_id", "node_id", (F.col("nodes") - F.col("from_begin")).alias("begin"), (F.col("nodes") - F.col("from_end")).alias("end"), F.col("depth").cast("int").alias("depth")
    )
    return log.join(stored(placed, "intervals"), ["run_id", "node_id"])


def ancestors(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, run_id, node_id, lever_id, depth): each of ``targets`` (run_id, node_id as target, at = its begin; few per run) with the nodes on its path, itself included."""
    return placed.join(targets, "run_id").filter("begin <= at AND at < end").select("target", "run_id", "node_id", "lever_id", "depth")
