"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.plans.lineage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: non-null longs): root is the smallest node reachable.

    Large-star and small-star rounds: each node hands its larger, then its smaller neighbours to the
    smallest node it knows, until every component is a star.  The minimum per node is a partial
    aggregate and is written before it is joined, so the join of a node with very many neighbours can be split.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ends.distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.filter("b > a").join(_least(both, "large"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "edges")
        low = _least(large, "small")
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _least(edges: DataFrame, name: str) -> DataFrame:
    """(a, m): the smallest of a node and its neighbours."""
    return stored(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")), name)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    mixed = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(mixed, 32)), F.sum(mixed.bitwiseAND(2**32 - 1))).first()
    return tuple(row)
