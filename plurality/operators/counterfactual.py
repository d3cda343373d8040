"""Does conditioning on a segment move the prediction in the right direction?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import dist
from plurality.plans.skew import attach

FAMILY = ["system", "dataset", "question"]


def segment_shifts(scored: DataFrame) -> DataFrame:
    """Cosine between predicted and true shift of every record against its question's weighted mean.

    Records weigh their group size, or one where it is missing or zero.  All labels of a question form its
    axis; a label that a record does not list has no mass there, so records may list different options
    in any order.  Questions with a single record are left out; a shift of (almost) zero length has no alignment.
    """
    rows = scored.select(
        *FAMILY,
        "record_id",
        "segment",
        dist.as_map(F.col("options"), F.col("p")).alias("truth_by_label"),
        dist.as_map(F.col("options"), F.col("q")).alias("pred_by_label"),
        F.when(F.col("group_size") > 0, F.col("group_size").cast("double")).otherwise(F.lit(1.0)).alias("w"),
    )
    # one pass over the scored rows: the entry without a label carries the record's weight and counts it
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("p"), F.lit(1.0).alias("q")))
    entries = F.transform(
        F.map_entries("truth_by_label"),
        lambda e: F.struct(e["key"].alias("label"), e["value"].alias("p"), F.try_element_at("pred_by_label", e["key"]).alias("q")),
    )
    long = rows.select(*FAMILY, "w", F.explode(F.concat(whole, F.coalesce(entries, F.slice(whole, 1, 0)))).alias("e")).select(*FAMILY, "w", "e.*")
    sums = long.groupBy(*FAMILY, "label").agg(
        F.sum(F.col("w") * F.col("p")).alias("wp"), F.sum(F.col("w") * F.col("q")).alias("wq"), F.count(F.lit(1)).alias("n")
    )
    total, labelled = F.col("label").isNull(), F.when(F.col("label").isNotNull(), F.struct("label", "wp", "wq"))
    families = sums.groupBy(*FAMILY).agg(
        F.max(F.when(total, F.col("wp"))).alias("total"), F.max(F.when(total, F.col("n"))).alias("n"), F.array_sort(F.collect_list(labelled)).alias("sums")
    )
    reference = families.filter((F.col("n") >= 2) & (F.size("sums") > 0)).select(
        *FAMILY,
        F.transform("sums", lambda s: F.struct(s["label"].alias("label"), (s["wp"] / F.col("total")).alias("p"), (s["wq"] / F.col("total")).alias("q"))).alias("ref"),
    )
    both = attach(rows, reference, FAMILY, ["record_id"], "inner")

    def shift(own: str, f: str):
        return F.transform("ref", lambda r: F.coalesce(F.try_element_at(F.col(own), r["label"]), F.lit(0.0)) - r[f])

    shifted = both.withColumns({"dp": shift("truth_by_label", "p"), "dq": shift("pred_by_label", "q")})
    return shifted.select(
        *FAMILY,
        "record_id",
        "segment",
        dist.cosine(F.col("dq"), F.col("dp")).alias("alignment"),
        dist.l2(F.col("dp")).alias("true_shift"),
    )


def alignment_by_system(shifts: DataFrame) -> DataFrame:
    """Mean alignment; records without one stay out of the mean."""
    return shifts.groupBy("system").agg(F.avg("alignment").alias("cf_alignment"), F.count("alignment").alias("n_aligned"))
