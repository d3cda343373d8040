"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source is read ``target / size`` times: every document gets the whole part as sure copies and the
fraction as the probability of one more.  Fractions are rounded in pairs: mass moves at random
between two documents, measured in words, until one of them is surely in or out, so expected copies
stay what they were and the words of the pair do not change.  Pairs are folded inside buckets of a
source; what a bucket leaves over (one document) goes to the next level of a tree, until one document
per source is left, which is rounded by its own probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.plans.lineage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
VOLUME = 1.5
MOST_COPIES = 2.0
FAN_IN = 256
UNIT = float(2**53)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources in code point order, null last, take the weights in turn.  They share ``volume`` times all
    words; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight.  The common level rises in rounds of one aggregation each, until no source is above its stop.
    Neither the numbering nor the level gathers the sources in one task.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    lined = stored(per_source.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    lined = lined.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lined.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(2**33 - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = stored(
        lined.join(starts, "_part").select("source", "source_size", "_docs", weight.alias("_weight"), (F.lit(float(most)) * F.col("source_size")).alias("_stop")),
        "weighted",
    )
    wanted = volume * (table.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("_stop") <= F.lit(level) * F.col("_weight")
        now = table.agg(
            F.sum(F.when(full, F.col("_stop"))).alias("stopped"),
            F.sum(F.when(~full, F.col("_weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if now["n"] == capped or not now["open"]:
            break
        capped, level = now["n"], (wanted - (now["stopped"] or 0.0)) / now["open"]
    target = F.least(F.col("_stop"), F.lit(level) * F.col("_weight"))
    return table.select("source", "source_size", "_docs", target.alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _with_mass(doc: Column, mass: Column) -> Column:
    return F.struct(*[(mass if c == "mass" else doc[c]).alias(c) for c in ("size", "mass", "doc_id", "sure", "u")])


def _settled(doc: Column) -> Column:
    return (doc["mass"] <= doc["size"] * 1e-12) | (doc["mass"] >= doc["size"] * (1 - 1e-12))


def _pair(holder: Column, item: Column) -> Column:
    """Both documents after the random transfer: one of them at least is settled, the sum of mass is kept."""

    def transfer(m: Column) -> Column:
        rise = item["u"] * (m["up"] + m["down"]) < m["down"]
        change = F.when(rise, m["up"]).otherwise(-m["down"])
        return F.array(_with_mass(holder, holder["mass"] + change), _with_mass(item, item["mass"] - change))

    up = F.least(holder["size"] - holder["mass"], item["mass"])
    down = F.least(holder["mass"], item["size"] - item["mass"])
    return _let(F.struct(up.alias("up"), down.alias("down")), transfer)


def _fold(items: Column, doc_type: str) -> Column:
    """(left, out) of one bucket: the fractional document that is left, if any, and the settled ones."""
    none = F.array().cast(f"array<{doc_type}>")

    def merge(state: Column, item: Column) -> Column:
        pool = F.when(F.size(state["left"]) == 0, F.array(item)).otherwise(_pair(state["left"][0], item))
        return _let(
            pool,
            lambda docs: F.struct(
                F.filter(docs, lambda d: ~_settled(d)).alias("left"),
                F.concat(state["out"], F.filter(docs, _settled)).alias("out"),
            ),
        )

    return F.aggregate(items, F.struct(none.alias("left"), none.alias("out")), merge)


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(UNIT)


def copies(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, most: float = MOST_COPIES, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) from (doc_id, source, size): one row per row.

    Words taken from a source differ from its target by less than one of its documents, and no document
    has more than ``most`` copies (rounded up).  The same rows and seed give the same copies.
    Null sources form one source, null doc_ids are kept, documents of no words get no copy, rows that are
    equal are rounded one by one, and an empty table gives an empty result.
    """
    sizes = stored(sizes.select("doc_id", "source", "size"), "sizes")
    per_source = targets(sizes, weights, volume, most).withColumnRenamed("source", "_source")
    most_docs = per_source.agg(F.max("_docs").alias("n")).first()["n"] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        sizes.join(per_source, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("_sure", F.floor("_rate").cast("long"))
        .withColumn("_doc", F.struct(
            F.col("size").cast("double").alias("size"),
            (F.col("size") * (F.col("_rate") - F.col("_sure"))).alias("mass"),
            "doc_id",
            F.when(F.col("size") > 0, F.col("_sure")).otherwise(F.lit(0)).cast("long").alias("sure"),
            F.lit(0.0).alias("u"),
        ))
        .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "doc_id", "size"), F.ceil(F.col("_docs") / FAN_IN)))
    )
    doc_type = rows.schema["_doc"].dataType.simpleString()
    keep = ["source", "source_size", "target"]
    open_rows = rows.filter(~_settled(F.col("_doc"))).select(*keep, "_bucket", F.col("_doc").alias("doc"))
    done = [rows.filter(_settled(F.col("_doc"))).select(*keep, F.col("_doc").alias("doc"))]
    level, buckets = 0, -(-most_docs // FAN_IN)
    while True:
        mixed = _with_u(open_rows, seed, level)
        folded = stored(
            mixed.groupBy(*keep, "_bucket")
            .agg(F.sort_array(F.collect_list("doc"), asc=False).alias("_docs"))
            .select(*keep, "_bucket", _fold(F.col("_docs"), doc_type).alias("_fold"))
            .select(*keep, "_bucket", "_fold.left", "_fold.out"),
            "fold",
        )
        done.append(folded.select(*keep, F.explode("out").alias("doc")))
        open_rows = folded.select(*keep, F.floor(F.col("_bucket") / FAN_IN).alias("_bucket"), F.explode("left").alias("doc"))
        if buckets <= 1:
            break
        level, buckets = level + 1, -(-buckets // FAN_IN)
    last = _with_u(open_rows, seed, level + 1)
    chosen = F.when(F.col("doc.u") * F.col("doc.size") < F.col("doc.mass"), F.col("doc.size")).otherwise(F.lit(0.0))
    done.append(last.select(*keep, _with_mass(F.col("doc"), chosen).alias("doc")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    more = F.when((F.col("doc.size") > 0) & (F.col("doc.mass") * 2 > F.col("doc.size")), F.lit(1)).otherwise(F.lit(0))
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "source", F.col("doc.size").cast("long").alias("size"), "source_size", "target",
        (F.col("doc.sure") + more).alias("copies"),
    )


def _with_u(rows: DataFrame, seed: int, level: int) -> DataFrame:
    u = _uniform(F.lit(seed), F.lit(level), F.col("doc.doc_id"), F.col("doc.size"))
    return rows.withColumn("doc", F.col("doc").withField("u", u))


def repeated(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` with every row as often as ``copies`` takes it, all columns kept.

    Rows with the same doc_id, source and size share a list of copies and take them in turn, so repeated rows and ids
    get what was drawn for them, each once.
    """
    key = ["doc_id", "source", "size"]
    drawn = copies(docs.select("doc_id", "source", word_count().alias("size")), seed=seed)
    lists = drawn.groupBy(*key).agg(F.sort_array(F.collect_list("copies")).alias("taken"))
    lists = lists.select(*[F.col(c).alias(f"of_{c}") for c in key], "taken")
    rows = docs.select(F.struct("*").alias("row")).select("row", "row.doc_id", "row.source", word_count("row.text").alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    rows = rows.join(lists, same)
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row.text")))
    alone = rows.filter(F.size("taken") == 1).withColumn("n", F.col("taken")[0])
    shared = rows.filter(F.size("taken") > 1).withColumn("n", F.col("taken")[turn - 1])
    both = alone.unionByName(shared).filter("n > 0").select("row", "n")
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")
