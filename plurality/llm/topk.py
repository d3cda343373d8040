"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors become integers floor(scale * x).  Candidates are dealt to shards and queries to blocks; every
(shard, block) is one task.  A shard holds, for each dimension, its postings in segments of one quantised value.
A query processes the segments of all dimensions by descending impact (its own component times the largest value
of the segment) and adds up partial scores.  What no segment has given yet is bounded by the largest
contribution left in each dimension.  It stops only when that bound proves that few candidates can be among
the first k; those are scored exactly from whole vectors.  The shards' winners are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.plans.lineage import stored

SCALE = 256.0
K = 5
SHARD = 4096
BLOCK = 1024
#: Values that share a segment: the width of a quantised impact.
LEVEL = 16
#: Postings of one wave, as a share of the index; possible members worth scoring, as a share of the shard.
WAVE = 1 / 12
FEW = 1 / 32


def usable(vector: str = "embedding") -> Column:
    """Not null, and no null or non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


class Index:
    """Postings of one shard, by dimension and quantised value."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, width = rows.shape
        level = rows // LEVEL
        dim = np.broadcast_to(np.arange(width), rows.shape)
        order = np.lexsort((np.broadcast_to(np.arange(n)[:, None], rows.shape).ravel(), level.ravel(), dim.ravel()))
        self.doc, flat_dim, flat_level = order // max(width, 1), dim.ravel()[order], level.ravel()[order]
        self.value = rows.ravel()[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (flat_dim[1:] != flat_dim[:-1]) | (flat_level[1:] != flat_level[:-1])
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(order))
        self.dim, self.level = flat_dim[self.begin], flat_level[self.begin]

    def search(self, query: np.ndarray, skip: np.ndarray, k: int) -> np.ndarray:
        """Places of the rows that can be among the first k (``skip``: rows that are no candidates)."""
        n, width = self.rows.shape
        open_rows = n - int(skip.sum())
        if open_rows <= k or not width:
            return np.flatnonzero(~skip)
        one, two = query[self.dim] * self.level * LEVEL, query[self.dim] * (self.level * LEVEL + LEVEL - 1)
        most, impact = np.maximum(one, two), np.maximum(np.abs(one), np.abs(two))
        order = np.argsort(-impact, kind="stable")
        sizes = (self.end - self.begin)[order]
        waves = np.searchsorted(np.cumsum(sizes), np.arange(WAVE, 1.0, WAVE) * sizes.sum()) + 1
        scores, at = np.zeros(n), 0
        scores[skip] = -np.inf
        for stop in np.unique(np.append(waves, len(order))):
            some = order[at:stop]
            at = stop
            many = self.end[some] - self.begin[some]
            places = np.repeat(self.begin[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
            scores += np.bincount(self.doc[places], weights=np.repeat(query[self.dim[some]], many) * self.value[places], minlength=n)
            left = np.zeros(width)
            np.maximum.at(left, self.dim[order[at:]], most[order[at:]])  # 0 where a dimension is done or only lowers scores
            best = np.argpartition(-scores, k - 1)[:k]
            bar = np.sort(self.rows[best] @ query)[0]
            possible = np.flatnonzero(scores + left.sum() >= bar)
            if len(possible) <= max(4 * k, int(n * FEW)):
                return possible
        return possible


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _task(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {c: [] for c in ("query_id", "query_key", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            index = Index(_matrix(left.column("vector"), width))
            for query_id, key, query in zip(right.column("vec_id").to_pylist(), right.column("key").to_pylist(), _matrix(right.column("vector"), width)):
                places = index.search(query, ids == query_id, k)
                exact = index.rows[places] @ query
                first = np.lexsort((ids[places], -exact))[:k]
                found["query_id"] += [query_id] * len(first)
                found["query_key"] += [key] * len(first)
                found["vec_id"] += ids[places][first].tolist()
                found["score"] += exact[first].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product per query, ties to the smaller vec_id.

    Both tables hold (vec_id, embedding).  A query's own vec_id is no candidate of it.  Fewer candidates than k are all
    returned.  Vectors that are null or hold null or non-finite components and rows without a vec_id take no part;
    zero vectors do.  A shorter vector counts as filled with zeros.  Queries that repeat an id with another
    vector are answered each; equal rows among the candidates stand each for itself.  Scores must fit a long.
    """
    spark = candidates.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        numbers = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
        return df.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("vector"))

    rows, asked = stored(whole(candidates), "candidates"), stored(whole(queries).distinct(), "queries")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    of_queries = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(shape["width"] or 0, of_queries["width"] or 0)
    shards, blocks = -(-shape["n"] // SHARD) or 1, -(-of_queries["n"] // BLOCK) or 1
    left = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    mixed = F.xxhash64("vector", "vec_id")
    right = asked.select("vec_id", "vector", F.xxhash64("vector").alias("key"), F.pmod(mixed, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    winners = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_task(width, k), "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = winners.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
