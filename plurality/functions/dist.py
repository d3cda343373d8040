"""Column functions on categorical distributions.

A distribution is a ``map<string,double>`` plus an ``options`` array that carries the
order; the vector functions below take the aligned ``array<double>`` form.  Every
function returns one Column and stays on the JVM, except ``temper_to_entropy`` and ``temper_to_entropies``, which
solve on whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Lambda bodies are not covered by common-subexpression elimination, so a repeated
    aggregate inside a ``transform`` would be recomputed per element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def align(dist: Column, options: Column) -> Column:
    """Vector of ``dist`` over ``options``; an absent label carries zero mass."""
    return F.transform(options, lambda o: F.coalesce(F.try_element_at(dist, o), F.lit(0.0)))


def axis(truth: Column, pred: Column) -> Column:
    """Shared label axis when no option list is known: truth's labels, then pred-only ones."""
    return F.concat(F.map_keys(truth), F.array_except(F.map_keys(pred), F.map_keys(truth)))


def clip0(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def renorm(v: Column) -> Column:
    """Scale to sum one; an all-zero vector becomes uniform, an empty one stays empty."""
    return let(
        v,
        lambda u: let(
            vsum(u),
            lambda s: F.when(s <= 0, F.transform(u, lambda _: F.lit(1.0) / F.size(u))).otherwise(
                F.transform(u, lambda x: x / s)
            ),
        ),
    )


def uniform(options: Column) -> Column:
    """Uniform vector over an option array (or over a vector of the same length)."""
    return F.transform(options, lambda _: F.lit(1.0) / F.size(options))


def as_map(options: Column, v: Column) -> Column:
    return F.map_from_arrays(options, v)


def tvd(p: Column, q: Column) -> Column:
    """Total variation distance of two vectors that already sum to one."""
    return vsum(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def tvd_to_uniform(p: Column) -> Column:
    return let(p, lambda u: vsum(F.transform(u, lambda x: F.abs(x - F.lit(1.0) / F.size(u)))) / 2)


def skill(distance: Column, z: Column) -> Column:
    """Skill score: 100 is perfect, 0 is uniform level, negative is worse; 0 when ``z`` is not positive.

    A ``z`` of rounding-noise size is a truth that is exactly uniform, and counts as zero.
    """
    return F.when(z <= TINY, F.lit(0.0)).otherwise(100.0 * (1.0 - distance / z))


def entropy(v: Column, normalized: bool = True, support_only: bool = False) -> Column:
    """Shannon entropy of a vector; normalised by log of the label count.

    ``support_only`` divides by log of the number of labels with positive mass instead.
    """

    def body(u: Column) -> Column:
        pos = F.filter(u, lambda x: x > 0)
        h = -vsum(F.transform(pos, lambda x: x * F.ln(x)))
        if not normalized:
            return F.when(F.size(pos) <= 1, F.lit(0.0)).otherwise(h)
        k = F.size(pos) if support_only else F.size(u)
        return F.when(F.size(pos) <= 1, F.lit(0.0)).otherwise(h / F.ln(k.cast("double")))

    return let(renorm(v), body)


def map_entropy(dist: Column) -> Column:
    return entropy(F.map_values(dist))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two shift vectors, NULL when either is (almost) zero."""
    norm = lambda v: F.sqrt(vsum(F.transform(v, lambda x: x * x)))
    dot = vsum(F.zip_with(a, b, lambda x, y: x * y))
    return let(
        F.struct(norm(a).alias("na"), norm(b).alias("nb"), dot.alias("dot")),
        lambda s: F.when((s["na"] < 1e-12) | (s["nb"] < 1e-12), F.lit(None).cast("double")).otherwise(
            s["dot"] / (s["na"] * s["nb"])
        ),
    )


def l2(v: Column) -> Column:
    return F.sqrt(vsum(F.transform(v, lambda x: x * x)))


def argmax(v: Column) -> Column:
    """1-based position of the largest entry, first one on ties; values equal up to rounding noise tie."""

    def body(u: Column) -> Column:
        top = F.array_max(u) - TINY
        return F.array_position(F.transform(u, lambda x: x >= top), F.lit(True)).cast("int")

    return let(v, body)


def descending(v: Column) -> Column:
    return F.sort_array(v, asc=False)


def shape_distance(p: Column, q: Column) -> Column:
    """TVD after both profiles are sorted: the part of the error no relabelling can remove."""
    return tvd(descending(p), descending(q))


# -- re-shaping a prediction -------------------------------------------------------


def temper(v: Column, temperature: Column) -> Column:
    """Temperature scaling: p^(1/T), renormalised; a non-positive T or zero mass gives uniform."""

    def body(u: Column) -> Column:
        return F.when((vsum(u) <= 0) | (temperature <= 0), uniform(u)).otherwise(
            renorm(F.transform(renorm(u), lambda x: F.pow(x, F.lit(1.0) / F.when(temperature > 0, temperature))))
        )

    return let(clip0(v), body)


def smooth(v: Column, alpha: Column) -> Column:
    """Additive smoothing toward uniform."""
    return renorm(F.transform(renorm(clip0(v)), lambda x: x + alpha))


def entropy_temperature(v: Column, slope: Column) -> Column:
    """Temperature that grows with the prediction's own normalised entropy."""
    return F.lit(1.0) + slope * entropy(v)


def shape_features(v: Column) -> Column:
    """Struct(peak, gap, entropy, n_eff) describing the profile of a prediction."""

    def body(p: Column) -> Column:
        return F.struct(
            F.get(p, 0).alias("peak"),
            F.when(F.size(p) > 1, F.get(p, 0) - F.get(p, 1)).otherwise(F.lit(1.0)).alias("gap"),
            entropy(p).alias("entropy"),
            (F.lit(1.0) / vsum(F.transform(p, lambda x: x * x))).alias("n_eff"),
        )

    return let(descending(renorm(clip0(v))), body)


def _padded(series: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) for x in series), dtype=np.int64, count=len(series))
    width = max(int(sizes.max(initial=0)), 1)
    mask = np.arange(width)[None, :] < sizes[:, None]
    out = np.zeros((len(sizes), width))
    if sizes.sum():
        out[mask] = np.concatenate([np.asarray(x, dtype=float) for x in series])
    return out, mask


#: Temperatures between which a wanted entropy is looked for, and the rows solved together.
COLDEST, HOTTEST = 1e-3, 1e3
SOLVED_AT_ONCE = 1024


def _tempered(logp: np.ndarray, mask: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Rows x targets x labels: each row at its inverse temperatures."""
    scaled = np.where(mask[:, None, :], logp[:, None, :] * beta[:, :, None], -np.inf)
    # subtracting the row maximum keeps the largest term at one, so sharp tempering cannot underflow to 0/0
    q = np.exp(scaled - scaled.max(axis=2, initial=-1e300)[:, :, None])
    return q / np.maximum(q.sum(axis=2), 1e-300)[:, :, None]


def _reach(logp: np.ndarray, mask: np.ndarray, log_k: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Rows x targets x labels: every row tempered to each wanted normalised entropy.

    Entropy rises with the logarithm s of the temperature, by beta^2 times the variance of the log probabilities.  Newton steps
    solve all targets of all rows together; a step that leaves its bracket, and every fourth, halves the bracket instead.
    """
    s, low, high = np.zeros_like(goal), np.full_like(goal, np.log(COLDEST)), np.full_like(goal, np.log(HOTTEST))
    safe = np.where(mask, logp, 0.0)[:, None, :]
    for turn in range(160):
        beta = np.exp(-s)
        q = _tempered(logp, mask, beta)
        h = -(q * np.log(np.where(q > 0, q, 1.0))).sum(axis=2) / log_k[:, None]
        below = h < goal
        low, high = np.where(below, s, low), np.where(below, high, s)
        mean = (q * safe).sum(axis=2)
        spread = (q * (safe - mean[:, :, None]) ** 2).sum(axis=2) * beta * beta
        with np.errstate(divide="ignore", invalid="ignore"):
            step = s + (goal - h) * log_k[:, None] / spread
        middle = (low + high) / 2
        after = np.where((step > low) & (step < high), step, middle) if turn % 4 < 3 else middle
        if (np.abs(after - s) < 1e-14).all():
            break
        s = after
    return _tempered(logp, mask, np.exp(-s))


def _retempered(v: pd.Series, targets: pd.Series) -> list[list[np.ndarray]]:
    """Per row a vector for each target; rows without mass or with one label pass through."""
    raw, mask = _padded(v)
    goal, _ = _padded(targets)
    raw = np.clip(raw, 0.0, None)
    size, total = mask.sum(axis=1), raw.sum(axis=1)
    live = (size > 1) & (total > 0)
    p = np.where(mask, np.clip(raw / np.where(live, total, 1.0)[:, None], 1e-9, None), 0.0)
    logp = np.log(np.where(mask, p / np.where(live, p.sum(axis=1), 1.0)[:, None], 1.0))
    goal, log_k, out = np.clip(goal, 0.0, 1.0), np.log(np.maximum(size, 2)), []
    for at in range(0, len(size), SOLVED_AT_ONCE):
        some = slice(at, at + SOLVED_AT_ONCE)
        q = np.where(live[some, None, None], _reach(logp[some], mask[some], log_k[some], goal[some]), raw[some, None, :])
        out += [[vector[:n] for vector in row[:g]] for row, n, g in zip(q, size[some], map(len, targets[some]))]
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def temper_to_entropies(v: pd.Series, targets: pd.Series) -> pd.Series:
    """Temper each vector until its normalised entropy equals each of ``targets`` (an array): one call for a whole grid."""
    return pd.Series(_retempered(v, targets))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def temper_to_entropy(v: pd.Series, target: pd.Series) -> pd.Series:
    """Temper each vector until its normalised entropy equals ``target``."""
    return pd.Series([row[0] for row in _retempered(v, pd.Series([[t] for t in target]))])
