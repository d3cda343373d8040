"""The acceptance gate of run logs as a scan over step functions.

Whether a node is accepted depends on the bar that the nodes before it left.  A stretch of nodes turns the bar at its entry into the bar at its
exit and a number of accepted nodes; as only the first accepted node depends on the entry, that map is a step function.  Maps of
neighbouring stretches compose, so they are folded up a tree in parallel; then the bars are handed down the tree, and
every stretch replays its own nodes from its own bar.

A score is accepted where ``score > bar + eta``.  In floating point that is ``bar < limit`` for one exact limit per node, so
folding and replaying never disagree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.plans.lineage import stored
from plurality.plans.ranking import gapless

#: log2 of the nodes of a stretch and of the stretches folded into one.
STRETCH_BITS, FOLD_BITS = 12, 6
#: Nodes of a sorted partition.
ROWS = 250_000


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order, and back."""
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _double(order: np.ndarray) -> np.ndarray:
    return np.where(order < 0, order ^ np.int64(2**63 - 1), order).view(np.float64)


def limits(score: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """The smallest bar at which each score is not accepted, found by halving among the doubles near ``score - eta``."""
    at = score - eta
    near = 4 * np.spacing(np.maximum(np.maximum(np.abs(score), np.abs(eta)), np.abs(at)))
    known = np.isfinite(near) & np.isfinite(at)
    low = _ordered(np.where(known, at - near, -np.inf))  # accepted here, but for a score below all bars
    high = _ordered(np.where(known, at + near, np.inf))
    while (high - 1 > low).any():
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        taken = score > _double(middle) + eta
        low, high = np.where(taken, middle, low), np.where(taken, high, middle)
    return np.where(score == -np.inf, -np.inf, _double(high))


class Steps:
    """Entry bar -> (exit bar, accepted): for a bar below ``upto[j]`` (the first such j) ``leaves[j]`` and ``taken[j]``; beyond, the bar stays.

    Known for bars below ``first``, the score that begins the stretch: no earlier score reaches it.
    """

    def __init__(self, first: float, upto: np.ndarray, leaves: np.ndarray, taken: np.ndarray):
        last = int(np.searchsorted(upto, first, "left")) + 1  # pieces for bars that cannot come are dropped
        upto, leaves, taken = upto[:last], leaves[:last], taken[:last]
        keep = np.ones(len(upto), dtype=bool)
        keep[:-1] = (leaves[1:] != leaves[:-1]) | (taken[1:] != taken[:-1])
        self.first, self.upto, self.leaves, self.taken = first, upto[keep], leaves[keep], taken[keep]

    @classmethod
    def of(cls, score: np.ndarray, limit: np.ndarray) -> Steps:
        """The map of nodes in order."""
        n = len(score)
        leaves, taken = np.empty(n), np.empty(n, dtype=np.int64)
        ahead, place = [], []  # nodes whose limit no node between reaches, nearest last; limits negated to search
        for i in range(n - 1, -1, -1):
            j = bisect_left(ahead, -score[i]) - 1
            leaves[i], taken[i] = (leaves[place[j]], taken[place[j]] + 1) if j >= 0 else (score[i], 1)
            while ahead and ahead[-1] >= -limit[i]:
                ahead.pop()
                place.pop()
            ahead.append(-limit[i])
            place.append(i)
        starts = np.array(place[::-1], dtype=np.int64)
        return cls(float(score[0]), limit[starts], leaves[starts], taken[starts])

    def __call__(self, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.upto, bar, "right")
        inside = at < len(self.upto)
        at = np.minimum(at, len(self.upto) - 1)
        return np.where(inside, self.leaves[at], bar), np.where(inside, self.taken[at], 0)

    def then(self, later: Steps) -> Steps:
        leaves, taken = later(self.leaves)
        beyond = later.upto > self.upto[-1]
        return Steps(self.first, np.append(self.upto, later.upto[beyond]), np.append(leaves, later.leaves[beyond]), np.append(self.taken + taken, later.taken[beyond]))


FOLDED = "slot long, first double, upto array<double>, leaves array<double>, taken array<long>"


def _row(run: pa.Array, slot: int, steps: Steps) -> pa.Table:
    values = [pa.array([steps.first]), *[pa.array([v.tolist()], pa.list_(k)) for v, k in ((steps.upto, pa.float64()), (steps.leaves, pa.float64()), (steps.taken, pa.int64()))]]
    return pa.table([run.slice(0, 1), pa.array([slot], pa.int64()), *values], names=["run_id", "slot", "first", "upto", "leaves", "taken"])


def _read(rows: pa.Table) -> Iterator[tuple[int, Steps]]:
    for r in rows.sort_by("slot").to_pylist():
        yield r["slot"], Steps(r["first"], np.array(r["upto"]), np.array(r["leaves"]), np.array(r["taken"], dtype=np.int64))


def _folded_nodes(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    steps = Steps.of(rows.column("val_score").to_numpy(), rows.column("limit").to_numpy())
    return _row(rows.column("run_id").combine_chunks(), rows.column("slot")[0].as_py(), steps)


def _folded(rows: pa.Table) -> pa.Table:
    whole = None
    for slot, steps in _read(rows):
        whole = whole.then(steps) if whole else steps
    return _row(rows.column("run_id").combine_chunks(), slot >> FOLD_BITS, whole)


def _handed_down(children: pa.Table, parent: pa.Table) -> pa.Table:
    """The bar and the count at the entry of every child."""
    bar, taken, out = np.array(parent.column("bar").to_pylist()), parent.column("taken")[0].as_py(), []
    for slot, steps in _read(children):
        out.append((slot, float(bar[0]), taken))
        bar, more = steps(bar)
        taken += int(more[0])
    slots, bars, counts = zip(*out)
    run = children.column("run_id").combine_chunks().take(pa.array([0] * len(out)))
    return pa.table([run, pa.array(slots, pa.int64()), pa.array(bars), pa.array(counts, pa.int64())], names=["run_id", "slot", "bar", "taken"])


def _replayed(nodes: pa.Table, entry: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("at")
    bar, taken, places, numbers = entry.column("bar")[0].as_py(), entry.column("taken")[0].as_py(), [], []
    for i, (score, limit) in enumerate(zip(nodes.column("val_score").to_pylist(), nodes.column("limit").to_pylist())):
        if bar < limit:
            bar, taken = score, taken + 1
            places.append(i)
            numbers.append(taken)
    some = nodes.take(pa.array(places, pa.int64()))
    return pa.table([some.column("run_id"), some.column("node_id"), pa.array(numbers, pa.int32())], names=["run_id", "node_id", "accepted_no"])


def _limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = limits(batch.column("val_score").to_numpy(), batch.column("eta").to_numpy())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("run_id", "step", "node_id", "val_score")], pa.array(made)], names=["run_id", "step", "node_id", "val_score", "limit"])


def accepted(highs: DataFrame, eta: Column) -> DataFrame:
    """(run_id, node_id, accepted_no) of the accepted ones of ``highs`` (run_id, step, node_id, val_score): a run's record highs, rising by step.

    A node without ``eta`` is never accepted.  A run is spread over as many tasks as it has stretches; a folded map has at most as many pieces as there are record
    highs less than eta above its first.
    """
    rows = highs.select("run_id", "step", "node_id", F.col("val_score").cast("double").alias("val_score"), eta.cast("double").alias("eta")).filter("eta IS NOT NULL AND NOT isnan(val_score)")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    run, node = f"run_id {kind['run_id']}", f"node_id {kind['node_id']}"
    made = stored(rows.mapInArrow(_limited, f"{run}, step {kind['step']}, {node}, val_score double, limit double"), "highs")
    parts = max(1, made.count() // ROWS)
    lined = made.repartitionByRange(parts, "run_id", "step").sortWithinPartitions("run_id", "step").withColumn("at", F.monotonically_increasing_id())
    lined = gapless(stored(lined, "lined")).withColumn("slot", F.shiftright("at", STRETCH_BITS))
    levels = [stored(lined.groupBy("run_id", "slot").applyInArrow(_folded_nodes, f"{run}, {FOLDED}"), "steps")]
    while not levels[-1].groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        above = F.shiftright("slot", FOLD_BITS)
        levels.append(stored(levels[-1].groupBy("run_id", above.alias("above")).applyInArrow(_folded, f"{run}, {FOLDED}"), "steps"))
    bars = levels[-1].select("run_id", "slot", F.lit(float("-inf")).alias("bar"), F.lit(0).cast("long").alias("taken"))
    for level in reversed(levels[:-1]):
        children = level.withColumn("above", F.shiftright("slot", FOLD_BITS)).groupBy("run_id", "above")
        bars = stored(children.cogroup(bars.groupBy("run_id", "slot")).applyInArrow(_handed_down, f"{run}, slot long, bar double, taken long"), "bars")
    return lined.groupBy("run_id", "slot").cogroup(bars.groupBy("run_id", "slot")).applyInArrow(_replayed, f"{run}, {node}, accepted_no int")
