"""From stored responses to predictions: parsing, tallies, averages, blends and routes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import dist, keys, text
from plurality.plans.lineage import stored
from plurality.plans.ranking import cumulative_counts, top_per_group


def parse_predictions(completions: DataFrame, cells: DataFrame) -> DataFrame:
    """One prediction per response; unreadable or massless ones become uniform and are flagged."""
    rows = completions.join(cells.select("record_id", "options"), "record_id")
    rows = rows.withColumn("_v", text.stated_vector(F.col("text"), F.col("options")))
    v = F.coalesce(F.col("_v"), dist.uniform(F.col("options")))
    return rows.select(
        *[c for c in completions.columns if c != "text"],
        dist.as_map(F.col("options"), v).alias("pred"),
        F.col("_v").isNull().alias("parse_failed"),
    )


def tally_votes(responses: DataFrame, cells: DataFrame, alpha: float = 0.5, groups: Sequence[str] = ("record_id",)) -> DataFrame:
    """Smoothed share of votes per option; without a single readable vote the record is uniform.

    Equal texts of a record are counted before they are parsed, so parsing runs once per
    distinct text.
    """
    distinct = responses.groupBy(*groups, "text").agg(F.count(F.lit(1)).alias("_n"))
    asked = distinct.join(cells.select("record_id", "options"), "record_id")
    parsed = asked.withColumn("_vote", text.vote(F.col("text"), F.col("options")))
    counts = parsed.groupBy(*groups, F.coalesce("_vote", F.lit("")).alias("_vote")).agg(
        F.sum("_n").alias("_n"), F.bool_or(F.col("_vote").isNull()).alias("_bad")
    )
    packed = counts.groupBy(*groups).agg(
        F.map_from_entries(
            F.filter(F.collect_list(F.when(~F.col("_bad"), F.struct("_vote", "_n"))), lambda x: x.isNotNull())
        ).alias("_m"),
        F.sum(F.when(~F.col("_bad"), F.col("_n")).otherwise(F.lit(0))).alias("n_votes"),
        F.sum(F.when(F.col("_bad"), F.col("_n")).otherwise(F.lit(0))).alias("n_failed"),
    )
    rows = packed.join(cells.select("record_id", "options"), "record_id")
    smoothed = F.transform("options", lambda o: F.coalesce(F.try_element_at("_m", o), F.lit(0)) + F.lit(float(alpha)))
    vector = F.when(F.col("n_votes") > 0, dist.renorm(smoothed)).otherwise(dist.uniform(F.col("options")))
    return rows.select(*groups, dist.as_map(F.col("options"), vector).alias("pred"), "n_votes", "n_failed")


def parse_draws(draws: DataFrame, cells: DataFrame) -> DataFrame:
    """Each draw's normalised vector, NULL where the response is unusable."""
    rows = draws.join(cells.select("record_id", "options"), "record_id")
    stated = text.stated_vector(F.col("text"), F.col("options"))
    return rows.withColumn("v", dist.let(stated, lambda v: F.when(v.isNotNull(), dist.renorm(v)))).drop("text")


def average_draws(parsed: DataFrame, weight: Column | None = None, groups: Sequence[str] = ("record_id",)) -> DataFrame:
    """Weighted mean of the usable draws; a record without any, or without weight, is uniform."""
    w = F.lit(1.0) if weight is None else weight
    ok = F.col("v").isNotNull()
    long = parsed.select(
        *groups,
        F.when(ok, w).otherwise(F.lit(0.0)).alias("w"),
        ok.alias("ok"),
        F.explode(F.arrays_zip(F.col("options").alias("o"), F.coalesce("v", dist.uniform(F.col("options"))).alias("v"))).alias("z"),
    )
    sums = long.groupBy(*groups, F.col("z.o").alias("option")).agg(
        F.sum(F.col("w") * F.col("z.v")).alias("s"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"),
    )
    packed = sums.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("option", "s"))).alias("e"),
        F.max("n_ok").alias("n_ok"),
        F.max("n_failed").alias("n_failed"),
    )
    labels = F.transform("e", lambda x: x["option"])
    vector = dist.renorm(F.transform("e", lambda x: x["s"]))
    return packed.select(*groups, dist.as_map(labels, vector).alias("pred"), "n_ok", "n_failed")


def coverage(parsed: DataFrame, groups: Sequence[str], usable: Column) -> DataFrame:
    """Readable and failed responses, and the share that had to fall back."""
    return parsed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(usable).alias("n_ok"),
        F.count_if(~usable).alias("n_failed"),
        F.avg((~usable).cast("double")).alias("fallback_rate"),
    )


def _times(weight: float):
    return lambda x: x * F.lit(weight)


def blend(preds: DataFrame, cells: DataFrame, weights: Mapping[str, float], name: str = "ensemble") -> DataFrame:
    """Fixed-weight mix of systems, each scaled to sum one first; systems without mass are skipped."""
    total = float(sum(weights.values()))
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    systems = list(weights)
    wide = (
        preds.filter(F.col("system").isin(*systems))
        .groupBy("record_id")
        .agg(*[F.first(F.when(F.col("system") == s, F.col("pred")), ignorenulls=True).alias(f"_{i}") for i, s in enumerate(systems)])
        .join(cells.select("record_id", "options"), "record_id")
    )
    zero = F.transform("options", lambda _: F.lit(0.0))
    acc = zero
    for i, s in enumerate(systems):
        v = dist.clip0(dist.align(F.col(f"_{i}"), F.col("options")))
        wide = wide.withColumn(f"_v{i}", F.when(F.col(f"_{i}").isNotNull(), v).otherwise(zero))
        part = F.when(dist.vsum(F.col(f"_v{i}")) > 0, dist.renorm(F.col(f"_v{i}"))).otherwise(zero)
        scaled = F.transform(part, _times(weights[s] / total))
        acc = F.zip_with(acc, scaled, lambda a, b: a + b)
    mixed = wide.withColumn("_mix", dist.renorm(acc))
    return mixed.select("record_id", F.lit(name).alias("system"), dist.as_map(F.col("options"), F.col("_mix")).alias("pred"))


def route(
    kinds: DataFrame, preds: DataFrame, routes: Mapping[str, str] | DataFrame, default: str, name: str = "router"
) -> DataFrame:
    """Each record takes the prediction of the system its task kind is routed to.

    ``routes`` is a small dict or a table (kind, system).
    """
    if isinstance(routes, DataFrame):
        listed = kinds.select("record_id", "kind").join(routes.dropDuplicates(["kind"]), "kind", "left")
        wanted = listed.select("record_id", "kind", F.coalesce("system", F.lit(default)).alias("system"))
    else:
        table = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
        wanted = kinds.select(
            "record_id", "kind", F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(default)).alias("system")
        )
    routed = wanted.join(preds, ["record_id", "system"])
    return routed.select("record_id", F.lit(name).alias("system"), "kind", F.col("system").alias("routed_to"), "pred")


def draw_spread(parsed: DataFrame) -> DataFrame:
    """Mean TVD over all pairs of a record's usable draws, without forming a pair.

    Per option the sum of |a - b| over all pairs follows from the sorted values: the value
    at rank r (of n) counts 2r + 1 - n times.
    """
    usable = parsed.filter(F.col("v").isNotNull())
    long = usable.select("record_id", F.explode(F.arrays_zip(F.col("options").alias("o"), F.col("v").alias("v"))).alias("z"))
    ranks = cumulative_counts(long.select("record_id", F.col("z.o").alias("o"), F.col("z.v").alias("x")), ["record_id", "o"], "x")
    copies = F.col("end") - F.col("start")
    signed = F.col("x") * copies * (F.col("start") + F.col("end") - F.col("total"))
    sums = ranks.groupBy("record_id").agg(F.sum(signed).alias("s"), F.max("total").alias("n_draws"))
    pairs = F.col("n_draws") * (F.col("n_draws") - 1) / 2
    return sums.filter(F.col("n_draws") >= 2).select("record_id", "n_draws", (F.col("s") / 2 / pairs).alias("inter_tvd"))


def panel_diversity(parsed: DataFrame, min_draws: int = 5) -> DataFrame:
    """Spread between draws and share of draws that agree on the most common top option."""
    usable = parsed.filter(F.col("v").isNotNull())
    modes = usable.groupBy("record_id", dist.argmax(F.col("v")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    agree = modes.groupBy("record_id").agg((F.max("n") / F.sum("n")).alias("mode_agreement"))
    return draw_spread(parsed).filter(F.col("n_draws") >= min_draws).join(agree, "record_id")


#: Draws of a record that are held in one row; records of more are ranked in slices.
HELD = 1000


def size_curve(
    parsed: DataFrame, truths: DataFrame, sizes: Sequence[int], repeats: int = 25, seed: int = 0
) -> DataFrame:
    """Mean score of random subsets of each record's draws, for every subset size.

    A subset is the first draws in a seeded hash order per repeat.  A record's draws are gathered once and all its
    repeats are made where they lie.  Records of more than ``HELD`` draws stay spread out: their draws are ranked in
    slices, and the largest size bounds what is kept.  ``truths`` has record_id, p and z.
    """
    usable = parsed.filter(F.col("v").isNotNull()).select("record_id", "draw", "v")
    counts = usable.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    many = stored(counts.filter(F.col("n") > HELD).select("record_id"), "many")
    draw = F.struct(F.col("draw").cast("string").alias("draw"), "v")
    few = usable if many.isEmpty() else usable.join(many, "record_id", "left_anti")
    held = few.groupBy("record_id").agg(F.collect_list(draw).alias("held")).withColumn("rep", F.lit(None).cast("int"))
    if few is not usable:
        rows = usable.join(many, "record_id").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        rows = rows.withColumn("_o", keys.hash_order(seed, F.col("record_id"), F.col("rep").cast("string"), F.col("draw").cast("string")))
        ranked = top_per_group(rows, ["record_id", "rep"], [F.col("_o")], max(sizes), ["draw", "rep"])
        held = held.unionByName(ranked.groupBy("record_id", "rep").agg(F.collect_list(draw).alias("held")))
    wanted = held.join(truths, "record_id").select("record_id", "rep", F.col("held.draw").alias("draws"), F.col("held.v").alias("vs"), "p", "z")
    scored = wanted.mapInArrow(_subset_scores(list(sizes), repeats, seed), "record_id string, size int, s double, n bigint")
    per_record = scored.groupBy("record_id", "size").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("s"))
    return per_record.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("score"))


def _subset_scores(sizes: list[int], repeats: int, seed: int):
    """Summed scores and their number per record and size: of all repeats, or of the one in ``rep``, whose first draws the row holds."""
    tiny = dist.TINY  # modules of this package travel by value, and ``dist`` holds functions that cannot

    def scores(record: str, rep: int | None, draws: list, vectors: np.ndarray, p: np.ndarray, z: float) -> np.ndarray:
        order = []
        for i in range(repeats) if rep is None else [rep]:
            start = f"{seed}::{record}::{i}"
            digests = [hashlib.sha256((start if d is None else f"{start}::{d}").encode()).digest() for d in draws]
            order.append(sorted(range(len(draws)), key=digests.__getitem__)[: max(sizes)])
        first = np.cumsum(vectors[np.array(order)], axis=1)
        first /= np.arange(1, first.shape[1] + 1)[:, None]
        distance = np.abs(first - p).sum(axis=2) / 2
        skill = np.zeros_like(distance) if z <= tiny else 100.0 * (1.0 - distance / z)
        return skill[:, [min(s, first.shape[1]) - 1 for s in sizes]].sum(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records, reps, zs = (batch.column(c).to_pylist() for c in ("record_id", "rep", "z"))
            draws, truths, known = batch.column("draws"), batch.column("p"), batch.column("p").is_valid().to_pylist()
            outer, inner = batch.column("vs").offsets.to_numpy(), batch.column("vs").values.offsets.to_numpy()
            flat = batch.column("vs").values.values.to_numpy(zero_copy_only=False)
            at, p = truths.offsets.to_numpy(), truths.values.to_numpy(zero_copy_only=False)
            sums, counts = np.zeros((len(records), len(sizes))), np.zeros(len(records), dtype=np.int64)
            for i, (record, rep, z) in enumerate(zip(records, reps, zs)):
                count = outer[i + 1] - outer[i]
                vectors = flat[inner[outer[i]] : inner[outer[i + 1]]].reshape(count, -1)
                if z is not None and known[i] and at[i + 1] - at[i] == vectors.shape[1]:
                    sums[i] = scores(record, rep, draws[i].as_py(), vectors, p[at[i] : at[i + 1]], z)
                    counts[i] = repeats if rep is None else 1
            names = batch.column("record_id").take(pa.array(np.repeat(np.arange(len(records)), len(sizes))))
            columns = [names, pa.array(np.tile(sizes, len(records)), pa.int32()), pa.array(sums.ravel()), pa.array(np.repeat(counts, len(sizes)))]
            yield pa.RecordBatch.from_arrays(columns, names=["record_id", "size", "s", "n"])

    return run


def blend_sweep(scored: DataFrame, first: str, second: str, weights: Sequence[float]) -> DataFrame:
    """Mean score and mean predicted entropy of every two-system mix; ``weight`` is the first system's."""
    pick = lambda s: F.first(F.when(F.col("system") == s, F.col("q")), ignorenulls=True)
    wide = (
        scored.filter(F.col("system").isin(first, second))
        .groupBy("record_id")
        .agg(F.first("p").alias("p"), F.first("z").alias("z"), F.first("tvd_u").alias("tvd_u"), pick(first).alias("a"), pick(second).alias("b"))
    )
    tried = wide.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    mix = F.zip_with("a", "b", lambda a, b: F.col("weight") * a + (1.0 - F.col("weight")) * b)
    tried = tried.withColumn("v", dist.renorm(mix))
    score = dist.skill(dist.tvd(F.col("p"), F.col("v")), F.coalesce("z", "tvd_u"))
    return tried.groupBy("weight").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("score"), F.avg(dist.entropy(F.col("v"))).alias("pred_h")
    )
