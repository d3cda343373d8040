"""What kind of error a prediction makes: wrong spread, or mass on the wrong options."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import dist
from plurality.functions.keys import hash_order
from plurality.functions.rounding import r6
from plurality.plans.ranking import cumulative_counts, ranked_by_hash
from plurality.plans.skew import attach

FACETS = ("tvd", "conc", "loc", "pred_entropy", "truth_entropy", "entropy_gap", "mode_match", "mode_mass_err")


def decompose(scored: DataFrame) -> DataFrame:
    """Add the error facets to a scored table.

    ``conc`` is the distance between the sorted profiles, ``loc`` the rest; with a positive
    ``z`` both are also given on the score scale, where they add up to ``100 - score``.
    """
    rows = scored.withColumns(
        {
            "conc": dist.shape_distance(F.col("p"), F.col("q")),
            "pred_entropy": dist.entropy(F.col("q")),
            "truth_entropy": dist.entropy(F.col("p")),
            "_mode": dist.argmax(F.col("p")),
            "_pred_mode": dist.argmax(F.col("q")),
        }
    )
    rows = rows.withColumns(
        {
            "loc": F.greatest(F.lit(0.0), F.col("tvd") - F.col("conc")),
            "entropy_gap": F.col("pred_entropy") - F.col("truth_entropy"),
            "mode_match": F.col("_mode") == F.col("_pred_mode"),
            "mode_mass_err": F.get("q", F.col("_mode") - 1) - F.get("p", F.col("_mode") - 1),
        }
    )
    loss = lambda c: F.when(F.col("z") > dist.TINY, 100.0 * F.col(c) / F.col("z"))
    return rows.withColumns(
        {"score_loss": loss("tvd"), "conc_loss": loss("conc"), "loc_loss": loss("loc")}
    ).drop("_mode", "_pred_mode")


def system_summary(decomposed: DataFrame, groups: Sequence[str] = ("system",)) -> DataFrame:
    """Mean facets per group, with the concentration and location shares of the error."""
    means = decomposed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("tvd").alias("mean_tvd"),
        F.avg("conc").alias("conc_err"),
        F.avg("loc").alias("loc_err"),
        F.avg("entropy_gap").alias("entropy_gap"),
        F.avg(F.col("mode_match").cast("double")).alias("mode_acc"),
        F.avg("mode_mass_err").alias("mode_mass_err"),
        F.avg("score_loss").alias("score_loss"),
        F.avg("conc_loss").alias("conc_loss"),
        F.avg("loc_loss").alias("loc_loss"),
    )
    whole = F.when(F.col("mean_tvd") > 0, F.col("mean_tvd"))
    return means.withColumns({"conc_share": F.col("conc_err") / whole, "loc_share": F.col("loc_err") / whole})


def gain_attribution(summary: DataFrame, base: str) -> DataFrame:
    """Change of each system against ``base`` on the score scale, and the facet that caused most of it."""
    everything = Window.partitionBy(F.lit(0))  # one summary row per system
    own = F.col("system") == base
    d = {
        c: F.max(F.when(own, F.col(c))).over(everything) - F.col(c) for c in ("score_loss", "conc_loss", "loc_loss")
    }
    rows = summary.select("system", *[d[c].alias(f"_{c}") for c in d]).filter(~own)
    d = {c: F.col(f"_{c}") for c in d}
    return rows.select(
        "system",
        d["score_loss"].alias("d_score"),
        d["conc_loss"].alias("d_conc"),
        d["loc_loss"].alias("d_loc"),
        F.when(F.abs(d["conc_loss"]) > F.abs(d["loc_loss"]), "concentration").otherwise("location").alias("driver"),
    )


def best_typical_worst(decomposed: DataFrame) -> DataFrame:
    """Best, middle and worst fitting grouped record of each system by TVD (ties by record hash).

    The middle row is located on counts per distinct TVD; only rows with exactly that TVD are ranked.
    """
    rows = decomposed.filter(F.col("split") == "grouped").select(
        "system", "record_id", "conc", "loc", r6("tvd").alias("tvd"), hash_order(0, F.col("record_id")).alias("_h")
    )
    pick = F.struct("record_id", "tvd", "conc", "loc")
    order = F.struct("tvd", "_h")
    ends = rows.groupBy("system").agg(
        F.min_by(pick, order).alias("best"), F.max_by(pick, order).alias("worst")
    )
    ends = ends.select("system", F.expr("stack(2, 'best', best, 'worst', worst) as (fit, r)")).select("system", "fit", "r.*")
    counts = cumulative_counts(rows, ["system"], "tvd")
    want = F.floor(F.col("total") / 2)
    middle = counts.filter((F.col("start") <= want) & (want < F.col("end"))).select(
        "system", "tvd", (want - F.col("start") + 1).alias("_k")
    )
    tied = attach(rows, middle, ["system", "tvd"], ["record_id"], "inner")
    typical = ranked_by_hash(tied, ["system"], "_h", "_r").filter(F.col("_r") == F.col("_k"))
    return ends.unionByName(typical.select("system", F.lit("typical").alias("fit"), "record_id", "tvd", "conc", "loc"))
