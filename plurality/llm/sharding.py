"""Uniform shuffle into shards of exact size, planned by a hypergeometric communication matrix.

1. Rows lie in buckets (a hash of the row, so a recomputed task finds the same bucket).
2. The driver draws how many rows each bucket sends to each shard: the multivariate hypergeometric
   law of a uniform shuffle, given the bucket sizes and the exact shard sizes.  The matrix has one
   row per bucket, never one per document.
3. Each bucket is permuted locally and cut at the drawn counts.
4. Each shard is permuted again, which gives the position of a row in its shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm import ranks
from plurality.plans.lineage import stored

LEAST_BUCKETS = 512
ROWS_PER_BUCKET = 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn without replacement, for populations of any size.

    Inverts the distribution function over the mode and twelve standard deviations around it; outside
    that window lies less than the resolution of a double.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    share = good / total
    spread = int(12 * (n * share * (1 - share) * (total - n) / max(1, total - 1)) ** 0.5) + 12
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(mass) - 1))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each bucket sends to each shard; row sums are ``sizes``, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(sizes), shards), dtype=np.int64)
    for b, left in enumerate(sizes):
        others = sum(room)
        for s in range(shards):
            others -= room[s]
            matrix[b, s] = hypergeometric(rng, room[s], others, left)
            left -= int(matrix[b, s])
        room = [r - int(m) for r, m in zip(room, matrix[b])]
    return matrix


def shuffle_shards(rows: DataFrame, shards: int, seed: int = 1, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add the shard and the gapless position in it to every row.

    The same rows and seed give the same result, whatever the partitioning.  Rows that are equal in
    every column are interchangeable.  Nulls hash like any value.  An empty table gives an empty
    result.  ``rows`` is read a few times and must have columns that can be ordered.
    """
    spark = rows.sparkSession

    def mixed(k: int):
        return F.xxhash64(F.lit(seed), F.lit(k), "row")

    total = rows.count()
    buckets = max(LEAST_BUCKETS, total // ROWS_PER_BUCKET)
    placed = rows.select(F.struct("*").alias("row")).select("row", F.pmod(mixed(0), F.lit(buckets)).cast("int").alias("home"), mixed(1).alias("order"))
    sizes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([sizes.get(b, 0) for b in range(buckets)], shards, seed)
    ends = spark.createDataFrame([(b, matrix[b].cumsum().tolist()) for b in range(buckets)], "home int, ends array<bigint>")
    cut = (
        ranks.gapless(placed, ["home"], "order", "rank", [F.col("row")], bits=2)
        .join(ends, "home")
        .select("row", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("part"), mixed(2).alias("again"))
    )
    return ranks.gapless(stored(cut, "shards"), ["part"], "again", "place", [F.col("row")]).select("row.*", F.col("part").alias(shard), F.col("place").alias(slot))


def sized(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (0 for null) and ``others`` of each row."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *others)
