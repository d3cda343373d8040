"""Approximate nearest neighbours on robust-pruned directed graphs, one graph per shard.

Different vectors are dealt to shards.  A shard's graph grows in batches: a greedy beam search over the part that
stands proposes neighbours for each new vector, robust pruning keeps those of which no kept one is ``ALPHA`` times nearer to them
than the new vector is (so edges point in different directions and long ones survive), and every edge is also offered backwards, where
a full list is pruned again.  Every query then walks every shard by beam search; what its beam holds is scored
exactly on the original vectors, and the shards' best are merged.

A shard is one stream of rows, its vectors first and then the queries: the graph is built once, and queries pass by in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.gridjoin import matrix, units, usable
from plurality.plans.lineage import stored

K = 5
#: Different vectors of a shard, about.
SHARD = 8192
#: Edges of a vector, places in the beam while building and while searching, and how many of them are opened at a time.
DEGREE = 32
BEAM = 48
SEARCH_BEAM = 128
OPENED = 4
ALPHA = 1.2
#: Vectors inserted, pruned or searched for together.
BATCH = 512


class Graph:
    """Unit vectors with at most ``degree`` outgoing edges each; -1 fills the lists."""

    def __init__(self, rows: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1):
        self.rows, self.degree, self.alpha = rows.astype(np.float32), degree, alpha
        self.edges = np.full((len(rows), degree), -1, dtype=np.int32)
        self.entry = int((self.rows @ self.rows.mean(axis=0)).argmax()) if len(rows) else -1
        order = np.random.default_rng(seed).permutation(len(rows))
        order = order[order != self.entry]
        at, size = 0, 1
        while at < len(order):
            self._insert(order[at : at + size], beam)
            at, size = at + size, min(BATCH, 2 * size)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances) of the nearest rows found per query, nearest first."""
        found, gaps, _ = self._walk(queries.astype(np.float32), beam)
        order = np.argsort(gaps, axis=1, kind="stable")
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(gaps, order, axis=1)

    def _walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Beams (places, squared distances) and all (query, place, squared distance) opened on the way.

        All queries walk together: each round opens the nearest unopened places of every beam and merges their unseen neighbours in.
        """
        many = len(queries)
        found, gaps = np.full((many, beam), -1, dtype=np.int32), np.full((many, beam), np.inf, dtype=np.float32)
        opened, seen = np.zeros((many, beam), dtype=bool), np.zeros((many, len(self.rows)), dtype=bool)
        found[:, 0], gaps[:, 0] = self.entry, 2 - 2 * queries @ self.rows[self.entry]
        seen[:, self.entry] = True
        last = np.empty(seen.shape, dtype=np.int32)
        path, live = [], np.arange(many)
        while len(live):
            waiting = np.where(opened[live] | (found[live] < 0), np.inf, gaps[live])
            nearest = np.argpartition(waiting, min(OPENED, beam) - 1, axis=1)[:, :OPENED]
            open_now = np.isfinite(np.take_along_axis(waiting, nearest, axis=1))
            keep = open_now.any(axis=1)
            live, nearest, open_now = live[keep], nearest[keep], open_now[keep]
            if not len(live):
                break
            row, slot = np.nonzero(open_now)
            slot = nearest[row, slot]
            opened[live[row], slot] = True
            node = found[live[row], slot]
            path.append((live[row], node, gaps[live[row], slot]))
            next_row, next_node = np.repeat(row, self.degree), self.edges[node].ravel()
            fresh = next_node >= 0
            next_row, next_node = next_row[fresh], next_node[fresh]
            fresh = ~seen[live[next_row], next_node]
            next_row, next_node = next_row[fresh], next_node[fresh]
            turn = np.arange(len(next_row), dtype=np.int32)
            last[live[next_row], next_node] = turn
            fresh = last[live[next_row], next_node] == turn  # two opened places may share a neighbour
            next_row, next_node = next_row[fresh], next_node[fresh]
            seen[live[next_row], next_node] = True
            gap = 2 - 2 * np.einsum("ij,ij->i", queries[live[next_row]], self.rows[next_node])
            counts = np.bincount(next_row, minlength=len(live))
            wide = int(counts.max(initial=0))
            if not wide:
                continue
            column = np.arange(len(next_row)) - np.repeat(np.cumsum(counts) - counts, counts)
            more, more_gaps = np.full((len(live), wide), -1, dtype=np.int32), np.full((len(live), wide), np.inf, dtype=np.float32)
            more[next_row, column], more_gaps[next_row, column] = next_node, gap
            all_gaps = np.concatenate([gaps[live], more_gaps], axis=1)
            best = np.argpartition(all_gaps, beam - 1, axis=1)[:, :beam]
            found[live] = np.take_along_axis(np.concatenate([found[live], more], axis=1), best, axis=1)
            gaps[live] = np.take_along_axis(all_gaps, best, axis=1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros_like(more, dtype=bool)], axis=1), best, axis=1)
        return found, gaps, path

    def _insert(self, new: np.ndarray, beam: int) -> None:
        _, _, path = self._walk(self.rows[new], beam)
        row, node, gap = (np.concatenate(x) for x in zip(*path))
        self._pruned(new, row, node, gap)
        heads = self.edges[new].ravel()
        tails = np.repeat(new, self.degree)[heads >= 0]
        self._offer(heads[heads >= 0], tails)

    def _offer(self, heads: np.ndarray, tails: np.ndarray) -> None:
        """Add edges head -> tail; lists that would be too long are pruned."""
        order = np.argsort(heads, kind="stable")
        heads, tails = heads[order], tails[order]
        while len(heads):
            owners, begin, many = np.unique(heads, return_index=True, return_counts=True)
            nth = np.arange(len(heads)) - np.repeat(begin, many)
            now = nth < 2 * self.degree  # a vector that very many name takes them in rounds
            row, tail = np.repeat(np.arange(len(owners)), many)[now], tails[now]
            old_row, old_at = np.nonzero(self.edges[owners] >= 0)
            row, tail = np.concatenate([old_row, row]), np.concatenate([self.edges[owners[old_row], old_at], tail])
            few = (np.bincount(row, minlength=len(owners)) <= self.degree)[row]
            order = np.argsort(row[few], kind="stable")
            held = row[few][order]
            sizes = np.bincount(held, minlength=len(owners))
            self.edges[owners[held], np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = tail[few][order]
            full = np.flatnonzero(np.bincount(row, minlength=len(owners)) > self.degree)
            for at in range(0, len(full), BATCH):
                part = full[at : at + BATCH]
                place = np.full(len(owners), -1)
                place[part] = np.arange(len(part))
                mine = place[row] >= 0
                gap = 2 - 2 * np.einsum("ij,ij->i", self.rows[owners[row[mine]]], self.rows[tail[mine]])
                self._pruned(owners[part], place[row[mine]], tail[mine], gap)
            heads, tails = heads[~now], tails[~now]

    def _pruned(self, owners: np.ndarray, row: np.ndarray, node: np.ndarray, gap: np.ndarray) -> None:
        """Robust pruning of the candidates (row of ``owners``, node, squared distance) to the owners' edges."""
        order = np.lexsort((node, gap, row))
        row, node, gap = row[order], node[order], gap[order]
        counts = np.bincount(row, minlength=len(owners))
        column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        wide = int(counts.max(initial=0))
        nodes, gaps = np.zeros((len(owners), wide), dtype=np.int32), np.full((len(owners), wide), np.inf, dtype=np.float32)
        nodes[row, column], gaps[row, column] = node, gap
        open_ = np.isfinite(gaps)
        vectors = self.rows[nodes]
        between = 2 - 2 * vectors @ vectors.transpose(0, 2, 1)
        self.edges[owners] = -1
        lines = np.arange(len(owners))
        for place in range(min(self.degree, wide)):
            pick = open_.argmax(axis=1)
            some = open_[lines, pick]
            if not some.any():
                break
            self.edges[owners[some], place] = nodes[lines[some], pick[some]]
            open_ &= self.alpha**2 * between[lines, pick] > gaps
            open_[lines, pick] = False


def _task(width: int, k: int, beam: int):
    """Rows (shard, asked, ids, key, vector), a shard's vectors before its queries, to the best candidates of each query."""

    def answers(graph: Graph, rows: np.ndarray, ids: list[list[int]], batch: pa.RecordBatch) -> pa.RecordBatch:
        asked = units(matrix(batch.column("vector"), width))
        out = {c: [] for c in ("query_id", "query_key", "vec_id", "score")}
        for at in range(0, len(asked), BATCH):
            some = asked[at : at + BATCH]
            found, _ = graph.search(some, min(beam, len(rows)))
            scores = np.einsum("ij,ikj->ik", some, rows[found])
            for i, (own, key) in enumerate(zip(batch.column("ids").slice(at, BATCH).to_pylist(), batch.column("key").slice(at, BATCH).to_pylist())):
                best = sorted((-s, j) for s, place in zip(scores[i].tolist(), found[i].tolist()) if place >= 0 for j in ids[place] if j != own[0])[:k]
                for name, values in zip(out, ([own[0]] * len(best), [key] * len(best), [j for _, j in best], [-s for s, _ in best])):
                    out[name] += values
        return pa.RecordBatch.from_arrays([*[pa.array(out[c], pa.int64()) for c in ("query_id", "query_key", "vec_id")], pa.array(out["score"], pa.float64())], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ids, rows, graph = None, [], [], None, None
        for whole in batches:
            marks = np.stack([whole.column("shard").to_numpy(), whole.column("asked").to_numpy()])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                batch = whole.slice(begin, end - begin)
                if not batch.num_rows:
                    continue
                if marks[0, begin] != shard:
                    shard, held, ids, rows, graph = marks[0, begin], [], [], None, None
                if not marks[1, begin]:
                    held.append(units(matrix(batch.column("vector"), width)))
                    ids += batch.column("ids").to_pylist()
                elif held:
                    if graph is None:
                        rows = np.concatenate(held)
                        graph = Graph(rows)
                    yield answers(graph, rows, ids, batch)

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest cosine found per query, ties to the smaller vec_id.

    Both tables hold (vec_id, embedding).  A query's own vec_id is no candidate of it.  Which candidates are found is approximate;
    scores and order are exact.  Fewer candidates than k are all returned.  Copies of a vector are one point of the graph,
    which keeps its k + 1 smallest vec_ids: more can never be needed.  Equal rows count once.  Vectors that are null, zero or
    hold null or non-finite components and rows without a vec_id take no part.  A shorter vector counts as filled with
    zeros.  Queries that repeat an id with another vector are answered each.  Empty tables give an empty result.
    """

    def whole(df: DataFrame) -> DataFrame:
        vector = F.transform("embedding", lambda x: x.cast("double"))
        return df.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))

    by_id = Window.partitionBy("vector").orderBy("vec_id")
    smallest = whole(candidates).withColumn("nth", F.dense_rank().over(by_id)).filter(F.col("nth") <= k + 1)
    points = stored(smallest.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "points")
    asked = stored(whole(queries).distinct(), "queries")
    shape = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(shape["width"] or 0, asked.agg(F.max(F.size("vector"))).first()[0] or 0)
    shards = -(-shape["n"] // shard) or 1
    of_points = points.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asked"), "ids", F.lit(0).cast("long").alias("key"), "vector")
    of_queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asked"), F.array("vec_id").alias("ids"), F.xxhash64("vector").alias("key"), "vector")
    streams = of_points.unionByName(of_queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asked")
    winners = streams.mapInArrow(_task(width, k, beam), "query_id long, query_key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = winners.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
