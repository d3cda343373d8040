from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plurality.operators import gate, runlog


def replayed(scores, etas, bar=float("-inf")):
    out = []
    for i, (s, e) in enumerate(zip(scores, etas)):
        if s > bar + e:
            bar = s
            out.append(i)
    return bar, out


def test_limits_decide_like_the_sum():
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-8, 17, 300), [0.1 + 0.2, 0.3, 1e20, 1.0, 0.0, 1.0, 0.3, -2.0]])
    eta = np.concatenate([np.abs(rng.normal(size=300)) * 10.0 ** rng.integers(-8, 17, 300), [0.1, 0.0, 1.0, 1e20, 0.0, 1.0, 0.3, 0.0]])
    limit = gate.limits(score, eta)
    for bar in (limit, np.nextafter(limit, -np.inf), np.nextafter(limit, np.inf), score - eta, score):
        assert ((bar < limit) == (score > bar + eta)).all()


@pytest.mark.parametrize("kind", ["steady", "slow", "mixed"])
def test_maps_of_stretches_compose(kind):
    rng = np.random.default_rng(len(kind))
    step = {"steady": 2.0, "slow": 0.01, "mixed": 0.3}[kind]
    for _ in range(40):
        scores = np.cumsum(rng.random(60) * step) + 0.5
        etas = rng.random(60) if kind == "mixed" else np.full(60, 1.0)
        limit = gate.limits(scores, etas)
        cuts = [0, *sorted(rng.choice(np.arange(1, 60), 4, replace=False).tolist()), 60]
        parts = [gate.Steps.of(scores[a:b], limit[a:b]) for a, b in zip(cuts, cuts[1:])]
        whole = parts[0].then(parts[1]).then(parts[2].then(parts[3])).then(parts[4])
        for bar in [float("-inf"), *(scores[0] - rng.random(10) * 3)]:
            left, taken = whole(np.array([bar]))
            want, own = replayed(scores, etas, bar)
            assert left[0] == want and taken[0] == len(own)


def test_many_runs_in_small_stretches(spark, monkeypatch):
    """Stretches of four nodes, folded by eights: several levels up and down; runs meet inside partitions, some etas are missing."""
    monkeypatch.setattr(gate, "STRETCH_BITS", 2)
    monkeypatch.setattr(gate, "FOLD_BITS", 3)
    monkeypatch.setattr(gate, "ROWS", 50)
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for run in range(4):
        scores = np.cumsum(rng.random(5 + 25 * run) * 0.8)
        etas = [None if rng.random() < 0.1 else float(rng.random() * 2) for _ in scores]
        rows += [(f"r{run}", i, f"n{i}", float(s), e) for i, (s, e) in enumerate(zip(scores, etas))]
        _, own = replayed(scores, [np.inf if e is None else e for e in etas])
        want |= {(f"r{run}", f"n{i}", k + 1) for k, i in enumerate(own)}
    highs = spark.createDataFrame(rows, "run_id string, step long, node_id string, val_score double, eta double")
    assert set(map(tuple, gate.accepted(highs, F.col("eta")).collect())) == want


def test_one_run_of_a_million_rising_nodes(spark):
    """Every node is a record high; no task sees the run as a whole."""
    n = 1_000_000
    log = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("step"), F.concat(F.lit("n"), "id").alias("node_id"), (F.col("id") / 4).alias("val_score"))
    out = gate.accepted(log, F.lit(1.0)).withColumn("task", F.spark_partition_id())
    got = out.agg(F.count(F.lit(1)).alias("n"), F.max("accepted_no").alias("last"), F.sum((F.expr("substr(node_id, 2)").cast("long") == (F.col("accepted_no") - 1) * 5).cast("long")).alias("right"), F.count_distinct("task").alias("tasks")).first()
    assert (got.n, got.last, got.right) == (n // 5, n // 5, n // 5) and got.tasks > 1


def test_empty_log(spark):
    empty = spark.createDataFrame([], "run_id string, seq long, node_id string, lever_id string, val_score double")
    assert runlog.gate_replay(empty, F.lit(1.0)).count() == 0
