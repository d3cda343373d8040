"""Leakage-safe splits, tags, seeded samples, folds and fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import keys
from plurality.plans.ranking import ranked_by_hash, top_per_group
from plurality.plans.skew import attach, with_totals
from plurality.sources.survey import sample_rows

# Default bucket shares and the tagged questions of the survey (fixed values).
FRACTIONS = {"dev": 0.5, "val": 0.25, "test": 0.25}
TAG_RULES = {
    "trust_president": "trust in the president",
    "gay_rights": "free to live their own life",
    "internet_use": "use the internet",
}


# -- tags --------------------------------------------------------------------------


def _rules(rules: Mapping[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("needle")) for n, v in rules.items()])


def matching_rules(text: Column, rules: Mapping[str, str]) -> Column:
    """Names of all rules whose needle occurs in the text, ignoring case, in rule order."""
    low = F.lower(text)
    hits = F.filter(_rules(rules), lambda r: F.contains(low, r["needle"]))
    return F.transform(hits, lambda r: r["name"])


def is_tagged(text: Column, rules: Mapping[str, str]) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for needle in rules.values():
        hit = hit | F.contains(low, F.lit(needle))
    return hit


def first_rule(text: Column, rules: Mapping[str, str]) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(v)), F.lit(n)) for n, v in rules.items()], F.lit(""))


def rows_by_rule(df: DataFrame, text: str, rules: Mapping[str, str]) -> DataFrame:
    """Every row once per rule it matches."""
    return df.withColumn("rule", F.explode(matching_rules(F.col(text), rules)))


# -- buckets -----------------------------------------------------------------------


def family(unit: str = "question") -> list[str]:
    units = {"question": ["dataset", "question"], "dataset": ["dataset"]}
    if unit not in units:
        raise ValueError(f"unit must be one of {sorted(units)}, got {unit!r}")
    return units[unit]


def make_split(
    cells: DataFrame,
    fractions: Mapping[str, float] = FRACTIONS,
    unit: str = "question",
    seed: int = 0,
    rules: Mapping[str, str] | None = None,
    pin_to: str | None = "test",
) -> DataFrame:
    """Add ``bucket``: all rows of a family share one, chosen by the family's own hash.

    Families with a tagged question go to ``pin_to``.  At question grain everything is
    local to the row, so no data moves; at dataset grain the pin flag is collected per
    dataset first.
    """
    total = sum(fractions.values())
    if total <= 0:
        raise ValueError("fractions must have a positive sum")
    if pin_to is not None and pin_to not in fractions:
        raise ValueError(f"pin_to must name a bucket of {list(fractions)}")
    rules = TAG_RULES if rules is None else rules
    names, edge, bucket = list(fractions), 0.0, None
    u = F.col("_u")
    for name in names[:-1]:
        edge += fractions[name] / total
        bucket = F.when(u < edge, name) if bucket is None else bucket.when(u < edge, name)
    bucket = F.lit(names[-1]) if bucket is None else bucket.otherwise(names[-1])
    rows = cells.withColumn("_u", keys.hash_unit(seed, *[F.col(c) for c in family(unit)]))
    if pin_to is None:
        return rows.withColumn("bucket", bucket).drop("_u")
    rows = rows.withColumn("_tagged", is_tagged(F.col("question"), rules))
    if unit != "question":
        pins = rows.groupBy(*family(unit)).agg(F.bool_or("_tagged").alias("_pin"))
        rows = attach(rows.drop("_tagged"), pins, family(unit), ["record_id"]).withColumnRenamed("_pin", "_tagged")
    return rows.withColumn("bucket", F.when(F.col("_tagged"), pin_to).otherwise(bucket)).drop("_u", "_tagged")


def split_summary(split: DataFrame, unit: str = "question", rules: Mapping[str, str] | None = None) -> DataFrame:
    """Families, records and tagged records per bucket; records are counted per family first."""
    rules = TAG_RULES if rules is None else rules
    per_family = split.groupBy("bucket", *family(unit)).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(is_tagged(F.col("question"), rules)).alias("_tagged")
    )
    return per_family.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("families"), F.sum("_n").alias("records"), F.sum("_tagged").alias("tagged_records")
    )


def leaking_families(split: DataFrame, unit: str = "question") -> DataFrame:
    """Families that appear in more than one bucket; empty when the split is safe."""
    spread = split.groupBy(*family(unit)).agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    return spread.filter(F.col("first") != F.col("last"))


LIMBS = 4


def fingerprint_sums(df: DataFrame, columns: Sequence[str] = ("dataset", "question")) -> DataFrame:
    """One row (l0 .. l3, n): the distinct rows' 128-bit digests added up in limbs of 32 bits, and how many there are.

    Addition knows no order, so partial sums meet in a tree, and the sums of parts without a common row add up to those of their union.
    """
    digest = F.sha2(F.to_json(F.array(*columns)), 256)
    limbs = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"l{i}") for i in range(LIMBS)]
    rows = df.select(digest.alias("h")).distinct().select(*limbs)
    return rows.agg(*[F.coalesce(F.sum(f"l{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"l{i}") for i in range(LIMBS)], F.count(F.lit(1)).alias("n"))


def add_sums(parts: DataFrame) -> DataFrame:
    """The sums of a union of disjoint parts from the parts' own."""
    return parts.agg(*[F.sum(f"l{i}").cast("decimal(38,0)").alias(f"l{i}") for i in range(LIMBS)], F.sum("n").alias("n"))


def finished(sums: DataFrame) -> DataFrame:
    """16-hex fingerprint and number of rows: limbs carried to one number modulo 2^128 and hashed with the count."""
    text, carry = [], "cast(0 as decimal(38,0))"
    for i in reversed(range(LIMBS)):
        whole = f"(l{i} + {carry})"
        text.insert(0, F.lpad(F.lower(F.hex(F.expr(f"cast({whole} % 4294967296 as bigint)"))), 8, "0"))
        carry = f"cast({whole} div 4294967296 as decimal(38,0))"
    return sums.select(F.substring(F.sha2(F.concat(*text, F.lit(":"), F.col("n").cast("string")), 256), 1, 16).alias("fingerprint"), F.col("n").alias("families"))


def fingerprint(df: DataFrame, columns: Sequence[str] = ("dataset", "question")) -> DataFrame:
    """16-hex fingerprint of the distinct rows, whatever their order."""
    return finished(fingerprint_sums(df, columns))


def ordered_fingerprint(df: DataFrame, columns: Sequence[str] = ("dataset", "question"), digits: int = 3) -> DataFrame:
    """16-hex fingerprint of the distinct rows' whole digests in sorted order, and their number.

    Row hashes are combined inside hash-prefix buckets, and only the bucket hashes meet.  Unlike ``fingerprint`` it hashes all bits
    of every row in a chain, so that no set of other rows can be made to add up to the same; parts do not merge.
    """
    one = F.sha2(F.to_json(F.array(*columns)), 256)
    hashes = df.select(one.alias("h")).distinct().withColumn("_prefix", F.substring("h", 1, digits))
    combined = F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256)
    buckets = hashes.groupBy("_prefix").agg(combined.alias("b"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_prefix", "b"))), lambda s: s["b"])
    return buckets.agg(
        F.substring(F.sha2(F.concat_ws("", ordered), 256), 1, 16).alias("fingerprint"), F.sum("n").alias("families")
    )


# -- samples -----------------------------------------------------------------------


def stratified_sample(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About ``n`` rows spread evenly over the datasets, in seeded hash order."""
    datasets = cells.select("dataset").distinct().count()
    per = max(1, n // max(datasets, 1))
    hashed = cells.withColumn("_order", keys.hash_order(seed, F.col("record_id")))
    picked = top_per_group(hashed, ["dataset"], [F.col("_order")], per, ["record_id"]).drop("_order")
    return picked if per * datasets <= n else sample_rows(picked, "record_id", n, seed)


def capped(cells: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` rows of each dataset by question text and segment."""
    rows = cells.withColumn("_seg", keys.segment_key(F.col("segment")))
    order = [F.col("question"), F.col("_seg")]
    return top_per_group(rows, ["dataset"], order, cap, ["record_id"]).drop("_seg")


def representative(cells: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """Up to ``cap`` rows per dataset: one per distinct question first, then the rest, in hash order."""
    hashed = cells.withColumn("_order", keys.hash_order(seed, F.col("record_id")))
    flagged = with_totals(hashed, ["dataset", "question"], [F.min("_order").alias("_lead")], ["record_id"])
    order = [F.col("_order") != F.col("_lead"), F.col("_order")]
    return top_per_group(flagged, ["dataset"], order, cap, ["record_id"]).drop("_order", "_lead")


def folds(cells: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``fold`` (0/1, alternating) and ``first_half`` by seeded rank inside each dataset."""
    hashed = cells.withColumn("_order", keys.hash_order(seed, F.col("record_id")))
    ranked = ranked_by_hash(hashed, ["dataset"], "_order", "_rank", "_total")
    return ranked.withColumns(
        {
            "fold": ((F.col("_rank") - 1) % 2).cast("int"),
            "first_half": F.col("_rank") <= F.floor(F.col("_total") / 2),
        }
    ).drop("_order", "_rank", "_total")


def disjoint_samples(cells: DataFrame, n_eval: int, n_fit: int, seed: int = 0) -> DataFrame:
    """Evaluation sample and a fit sample that shares no record with it, tagged by ``part``."""
    evaluation = stratified_sample(cells, n_eval, seed)
    rest = cells.join(evaluation.select("record_id"), "record_id", "left_anti")
    fit = stratified_sample(rest, n_fit, seed + 1)
    return evaluation.withColumn("part", F.lit("eval")).unionByName(fit.withColumn("part", F.lit("fit")))
