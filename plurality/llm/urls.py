"""URL filters: host and path rules, and boosted trees over lexical features where no rule fits.

Everything is a DataFrame expression or aggregation.  URLs that a rule judges are the labelled ones: a bounded
sample of them teaches.  Features are cut into bins; each level of a tree is one aggregation of gradients per (node,
feature, bin), a table of a few hundred rows, from which the driver picks the splits.  A tree is a nested CASE.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.plans.lineage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Labelled URLs that teach, at most.
MOST_LABELLED = 50_000
TREES, DEPTH, BINS = 10, 3, 16
RATE, SHRINK = 0.4, 1.0
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "host_length", "labels", "hyphens", "path_length", "longest", "suffix_length", "suffix_pages", "suffix_blocked")


def host(url: str = "url") -> Column:
    """Between the first :// and the next slash, question mark or hash, A-Z lower-cased; '' for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[tuple[str, str, str]], host_: Column, path_: Column) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the start of the path; null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(F.length(c) > 0, -share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(size > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path, suffix (the host's last label) and the lexical features of the url."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    out = pages.withColumn("host", host()).withColumn("path", path()).withColumn("suffix", F.substring_index("host", ".", -1))
    size = F.length(url)
    return out.withColumns({
        "length": size.cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digits": F.when(size > 0, (size - F.length(F.translate(url, "0123456789", ""))) / size).otherwise(0.0),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "host_length": F.length("host").cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": (size - F.length(F.translate(url, "-_", ""))).cast("double"),
        "path_length": F.length("path").cast("double"),
        "longest": F.array_max(F.transform(F.split("path", "/"), lambda x: F.length(x))).cast("double"),
        "suffix_length": F.length("suffix").cast("double"),
    })


def suffix_statistics(pages: DataFrame) -> DataFrame:
    """(suffix, suffix_pages, suffix_blocked): log of the pages, and the smoothed share blocked among those that a rule judges."""
    blocked = F.count(F.when(F.col("_rule.verdict") == "block", 1))
    judged = F.count("_rule")
    return pages.groupBy("suffix").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("suffix_pages"), ((blocked + 1.0) / (judged + 2.0)).alias("suffix_blocked"))


def _binned(edges: dict[str, list[float]]) -> Column:
    """Bin of every feature: how many of its edges lie below the value."""
    return F.array(*[reduce(lambda n, e: n + (F.col(f) > e).cast("int"), edges[f], F.lit(0)) for f in FEATURES])


def _tree(table: DataFrame, odds: Column) -> Column:
    """One tree on the gradients of the logistic loss: a Column of its value, from the column ``bins``."""
    chance = 1 / (1 + F.exp(-odds))
    rows = table.select("bins", (F.col("weight") * (chance - F.col("blocked"))).alias("g"), (F.col("weight") * chance * (1 - chance)).alias("h"))
    paths: dict[int, Column] = {1: F.lit(True)}  # heap numbers of the open nodes
    splits: dict[int, tuple[int, int]] = {}
    values: dict[int, float] = {}
    for level in range(DEPTH + 1):
        if not paths:
            break
        node = reduce(lambda out, item: F.when(item[1], item[0]).otherwise(out), paths.items(), F.lit(0))
        sums = (
            rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
            .filter("node > 0").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        )
        below: dict[int, Column] = {}
        for n, here in paths.items():
            own = sorted((r["feature"], r["bin"], r["g"], r["h"]) for r in sums if r["node"] == n)
            g, h = (math.fsum(r[k] for r in own if r[0] == 0) for k in (2, 3))
            values[n] = -g / (h + SHRINK)
            best = None
            for feature in range(len(FEATURES)) if level < DEPTH else ():
                left_g = left_h = 0.0
                for _, bin_, bin_g, bin_h in (r for r in own if r[0] == feature):
                    left_g, left_h = left_g + bin_g, left_h + bin_h
                    gain = left_g**2 / (left_h + SHRINK) + (g - left_g) ** 2 / (h - left_h + SHRINK) - g**2 / (h + SHRINK)
                    if gain > 1e-6 and h - left_h > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, feature, bin_)
            if best:
                splits[n] = best[1:]
                goes_left = F.col("bins")[best[1]] <= best[2]
                below |= {2 * n: here & goes_left, 2 * n + 1: here & ~goes_left}
        paths = below

    def grow(n: int) -> Column:
        if n not in splits:
            return F.lit(RATE * values[n])
        feature, bin_ = splits[n]
        return F.when(F.col("bins")[feature] <= bin_, grow(2 * n)).otherwise(grow(2 * n + 1))

    return grow(1)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, most: int = MOST_LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of ``pages`` (page_id, url).

    The longest rule that fits decides; elsewhere the trees do (block from a score of 0.5 on), taught with equal weight
    for both verdicts.  Where no URL of the table is judged by a rule, nothing is learnt and pages pass.  Null urls and urls without :// have an empty host and path and are judged
    by their features.  Repeated rows are judged each; null page_ids are kept; an empty table gives an empty result.
    """
    base = lexical(pages.select("page_id", "url")).withColumn("_rule", rule_of(rules, F.col("host"), F.col("path")))
    stats = stored(suffix_statistics(base), "suffixes")
    rows = base.join(stats, "suffix")
    labelled = base.filter("_rule IS NOT NULL")
    count = labelled.count()
    share = min(1.0, most / max(count, 1))
    picked = labelled.filter(F.pmod(F.xxhash64("url", "page_id"), F.lit(2**32)) < int(share * 2**32))
    taught = picked.join(stats, "suffix").select(*FEATURES, F.when(F.col("_rule.verdict") == "block", 1.0).otherwise(0.0).alias("blocked"))
    taught = stored(taught, "labelled")
    points = [i / BINS for i in range(1, BINS)]
    cuts = taught.agg(F.avg("blocked").alias("share"), *[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    rate = min(max(cuts["share"] or 0.0, 1e-3), 1 - 1e-3)
    weight = F.when(F.col("blocked") == 1, 0.5 / rate).otherwise(0.5 / (1 - rate))  # both verdicts weigh the same
    table = stored(taught.select("blocked", weight.alias("weight"), _binned(edges).alias("bins")), "binned")
    odds = F.lit(0.0 if count else -1.0)
    for _ in range(TREES if count else 0):
        odds = odds + _tree(table, odds)
    scored = rows.withColumn("bins", F.when(F.col("_rule").isNull(), _binned(edges))).withColumn("score", 1 / (1 + F.exp(-odds)))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_rule").isNull(), F.col("score")).alias("score"))
