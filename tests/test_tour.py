from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plurality.operators import runlog, tour


def log_of(spark, rows):
    """Rows (run, node, parent, seq)."""
    full = [(r, n, p, s, f"l{s}", 1.0, 0.5 * s) for r, n, p, s in rows]
    return spark.createDataFrame(full, "run_id string, node_id string, parent_id string, seq long, lever_id string, val_score double, cost_usd double")


def walked(rows):
    """(begin, end, depth) per (run, node), by recursion."""
    out, have = {}, {(r, n) for r, n, _, _ in rows}
    below = {}
    for r, n, p, s in rows:
        below.setdefault((r, p if (r, p) in have else None), []).append((s, n))

    def visit(run, node, depth, at):
        begin = at
        at += 1
        for _, child in sorted(below.get((run, node), [])):
            at = visit(run, child, depth + 1, at)
        out[run, node] = (begin, at, depth)
        return at

    for run in {r for r, *_ in rows}:
        at = 0
        for _, node in sorted(below.get((run, None), [])):
            at = visit(run, node, 0, at)
    return out


def test_random_forests(spark):
    """Several runs with dangling parents, hot parents, repeated seqs and runs of one node."""
    rng = random.Random(1)
    rows = []
    for run, n in (("a", 1), ("b", 60), ("c", 90)):
        for i in range(n):
            parent = None if i == 0 else "gone" if rng.random() < 0.05 else "n0" if rng.random() < 0.4 else f"n{rng.randrange(i)}"
            rows.append((run, f"n{i}", parent, rng.randrange(40)))
    log = log_of(spark, rows)
    want = walked(rows)
    got = {(r.run_id, r.node_id): (r.begin, r.end, r.depth) for r in tour.intervals(log).collect()}
    assert got == want
    cost = {(r, n): 0.5 * s for r, n, _, s in rows}
    order = {(r, want[r, n][0]): cost[r, n] for r, n, _, _ in rows}
    for r in runlog.subtree_totals(log).collect():
        begin, end, depth = want[r.run_id, r.node_id]
        assert (r.nodes, r.depth) == (end - begin, depth) and r.cost_usd == pytest.approx(sum(order[r.run_id, i] for i in range(begin, end)))


def test_chain_of_a_hundred_thousand(spark):
    n = 100_000
    log = spark.range(n).select(
        F.lit("r").alias("run_id"), F.col("id").cast("string").alias("node_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.col("id").alias("seq")
    )
    own = F.col("node_id").cast("long")
    bad = tour.intervals(log).filter((F.col("begin") != own) | (F.col("end") != n) | (F.col("depth") != own))
    assert bad.count() == 0


def test_circles_and_empty_logs(spark):
    with pytest.raises(ValueError):
        tour.intervals(log_of(spark, [("r", "a", "b", 0), ("r", "b", "a", 1), ("r", "c", None, 2)]))
    assert tour.intervals(log_of(spark, [])).count() == 0
