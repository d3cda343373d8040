"""Closed-form cases of the distribution functions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plurality.functions import dist


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def dmap(**kw):
    return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(float(v)))])


def opts(*names):
    return F.array(*[F.lit(n) for n in names])


@pytest.mark.parametrize(
    "p, q, want", [((0.5, 0.5), (0.5, 0.5), 0.0), ((1, 0), (0, 1), 1.0), ((0.7, 0.3), (0.3, 0.7), 0.4)]
)
def test_tvd(spark, p, q, want):
    assert value(spark, dist.tvd(vec(*p), vec(*q))) == pytest.approx(want)
    assert value(spark, dist.tvd(vec(*q), vec(*p))) == pytest.approx(want)


def test_renorm_zero_and_empty(spark):
    assert value(spark, dist.renorm(vec(0, 0, 0, 0))) == [0.25] * 4
    assert value(spark, dist.renorm(F.array().cast("array<double>"))) == []


def test_missing_label_is_zero_mass_and_axis(spark):
    assert value(spark, dist.align(dmap(A=0.4), opts("A", "B"))) == [0.4, 0.0]
    assert value(spark, dist.axis(dmap(A=1, B=0), dmap(C=1, A=0))) == ["A", "B", "C"]


def score(spark, pred, truth, z=None):
    p, q = dist.renorm(vec(*truth)), dist.renorm(vec(*pred))
    denominator = F.lit(float(z)) if z is not None else dist.tvd_to_uniform(p)
    return value(spark, dist.skill(dist.tvd(p, q), denominator))


def test_score(spark):
    assert score(spark, (0.7, 0.3), (0.7, 0.3)) == pytest.approx(100)
    assert score(spark, (0.5, 0.5), (0.7, 0.3)) == pytest.approx(0, abs=1e-9)
    assert score(spark, (0.1, 0.9), (0.9, 0.1)) < 0
    assert score(spark, (0.9, 0.1), (0.5, 0.5)) == 0
    assert score(spark, (7, 3), (0.7, 0.3)) == pytest.approx(100)
    assert score(spark, (0.6, 0.4), (0.7, 0.3), z=0.5) == pytest.approx(80)


def test_entropy(spark):
    assert value(spark, dist.entropy(vec(1, 1, 1))) == pytest.approx(1)
    assert value(spark, dist.entropy(vec(1, 0, 0))) == 0
    assert value(spark, dist.entropy(vec(0.5, 0.5, 0))) == pytest.approx(math.log(2) / math.log(3))
    assert value(spark, dist.entropy(vec(0.5, 0.5, 0), support_only=True)) == pytest.approx(1)
    assert value(spark, dist.entropy(vec(0.5, 0.5), normalized=False)) == pytest.approx(math.log(2))


def test_cosine(spark):
    assert value(spark, dist.cosine(vec(1, -1), vec(2, -2))) == pytest.approx(1)
    assert value(spark, dist.cosine(vec(1, -1), vec(-1, 1))) == pytest.approx(-1)
    assert value(spark, dist.cosine(vec(0, 0), vec(1, -1))) is None


def test_shape_distance_pure_cases(spark):
    assert value(spark, dist.shape_distance(vec(0.7, 0.3), vec(0.3, 0.7))) == pytest.approx(0)
    assert value(spark, dist.shape_distance(vec(0.9, 0.1), vec(0.6, 0.4))) == pytest.approx(0.3)


def test_argmax_takes_first_on_ties(spark):
    assert value(spark, dist.argmax(vec(0.2, 0.4, 0.4))) == 2


def test_temper_and_smooth(spark):
    p = np.array([0.6, 0.3, 0.1])
    for t in (0.5, 1.0, 2.0):
        want = p ** (1 / t) / (p ** (1 / t)).sum()
        assert value(spark, dist.temper(vec(*p), F.lit(t))) == pytest.approx(want.tolist())
    assert value(spark, dist.temper(vec(*p), F.lit(0.0))) == pytest.approx([1 / 3] * 3)
    assert value(spark, dist.temper(vec(0, 0), F.lit(1.0))) == [0.5, 0.5]
    assert value(spark, dist.smooth(vec(1, 0), F.lit(0.5))) == pytest.approx([0.75, 0.25])


@pytest.mark.parametrize("target", [0.3, 0.8, 1.0])
def test_temper_to_entropy_hits_target_and_keeps_ranking(spark, target):
    rows = [([0.7, 0.2, 0.1],), ([0.4, 0.3, 0.2, 0.1],), ([1.0, 0.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    out = df.withColumn("q", dist.temper_to_entropy("v", F.lit(target)))
    for r in out.withColumn("h", dist.entropy(F.col("q"))).collect():
        assert r["h"] == pytest.approx(target, abs=1e-4)
        assert np.argmax(r["q"]) == np.argmax(r["v"])


def test_temper_to_entropy_matches_column_form(spark):
    """The batch bisection against the same fifty halvings as a plain column expression."""
    df = spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.55, 0.25, 0.15, 0.05],)], "v array<double>")
    bounds = F.struct(F.lit(1e-3).alias("lo"), F.lit(1e3).alias("hi"))

    def halve(b, _):
        mid = (b["lo"] + b["hi"]) / 2
        low = dist.entropy(dist.temper(F.col("v"), mid)) < 0.5
        return F.struct(F.when(low, mid).otherwise(b["lo"]).alias("lo"), F.when(low, b["hi"]).otherwise(mid).alias("hi"))

    t = F.aggregate(F.sequence(F.lit(1), F.lit(50)), bounds, halve, lambda b: (b["lo"] + b["hi"]) / 2)
    out = df.withColumn("a", dist.temper(F.col("v"), t)).withColumn("b", dist.temper_to_entropy("v", F.lit(0.5)))
    for r in out.collect():
        assert r["a"] == pytest.approx(r["b"], abs=1e-6)


def test_temper_to_entropy_passes_degenerate_rows(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0],), ([],)], "v array<double>")
    assert [r["q"] for r in df.select(dist.temper_to_entropy("v", F.lit(0.5)).alias("q")).collect()] == [[0, 0], [1], []]


def test_shape_features(spark):
    got = value(spark, dist.shape_features(vec(2, 1, 1)))
    assert got["peak"] == pytest.approx(0.5)
    assert got["gap"] == pytest.approx(0.25)
    assert got["n_eff"] == pytest.approx(1 / (0.25 + 0.125))
    assert value(spark, dist.shape_features(vec(3)))["gap"] == 1.0
