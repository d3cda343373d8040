"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned to principal axes (a rotation from the exact second moments of all rows) and
sorted by their grid cells on the leading axes, cells as wide as the distance that the cosine allows.  The
sequence is cut into intervals whose boxes are known; only pairs of intervals whose boxes are near enough meet
in a task.  There the two sequences are halved recursively: a pair of blocks is skipped when the boxes prove
the distance, and small blocks are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.graph import components
from plurality.plans.lineage import stored

COSINE = 0.95
AXES = 8
#: Rows of an interval at least, and intervals at most: only their boxes reach the driver.
INTERVAL = 4096
MOST_INTERVALS = 4096
LEAF = 256
#: Boxes are compared with this much given away, so rounding never skips a pair.
SLACK = 1e-7


def usable(vector: str = "embedding") -> Column:
    """Neither null nor zero, and no null or non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as doubles; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.astype(np.float64).reshape(len(column), width)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns are the axes, largest second moment first; only sums per pair of components reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                unit = units(matrix(batch.column("vector"), width))
                total += unit.T @ unit
        at = np.arange(width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, width)), pa.array(np.tile(at, width)), pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((width, width))
    for r in vectors.mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


class Tree:
    """A sequence halved down to leaves, with the box of every part on the leading axes."""

    def __init__(self, along: np.ndarray):
        self.along, self.parts, self.low, self.high = along, [], [], []
        self.root = self._add(0, len(along))

    def _add(self, begin: int, end: int) -> int:
        below = []
        if end - begin > LEAF:
            middle = (begin + end) // 2
            below = [self._add(begin, middle), self._add(middle, end)]
        self.parts.append((begin, end, below))
        self.low.append(self.along[begin:end].min(axis=0))
        self.high.append(self.along[begin:end].max(axis=0))
        return len(self.parts) - 1


def apart(low_a, high_a, low_b, high_b):
    """Squared distance between boxes."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return (gap * gap).sum(axis=-1)


def near_blocks(a: Tree, b: Tree, reach: float) -> Iterator[tuple[int, int, int, int]]:
    """Leaf pairs that the boxes can't rule out; of a sequence with itself each pair once."""
    stack = [(a.root, b.root)]
    while stack:
        i, j = stack.pop()
        (begin, end, left), (other, other_end, right) = a.parts[i], b.parts[j]
        if a is b and begin >= other_end or apart(a.low[i], a.high[i], b.low[j], b.high[j]) > reach:
            continue
        if left or right:
            stack += [(x, y) for x in left or [i] for y in right or [j]]
        else:
            yield begin, end, other, other_end


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect a block as all its links do; a spanning forest where they are many."""
    if np.count_nonzero(linked) <= sum(linked.shape):
        return np.nonzero(linked)
    rows, cols = [], []
    row_open, col_open = linked.any(axis=1), linked.any(axis=0)
    while row_open.any():
        edge = np.array([np.flatnonzero(row_open)[0]])
        row_open[edge] = False
        while len(edge):
            new = np.flatnonzero(linked[edge].any(axis=0) & col_open)
            rows.append(edge[linked[np.ix_(edge, new)].argmax(axis=0)])
            cols.append(new)
            col_open[new] = False
            edge = np.flatnonzero(linked[:, new].any(axis=1) & row_open)
            rows.append(edge)
            cols.append(new[linked[np.ix_(edge, new)].argmax(axis=1)] if len(edge) else edge)
            row_open[edge] = False
    return np.concatenate(rows), np.concatenate(cols)


def _join_pair(width: int, axes: np.ndarray, cosine: float):
    """The task of one pair of intervals (or of one with itself): links counted per vector, and connecting edges."""
    reach = 2.0 - 2.0 * cosine + SLACK

    def sequence(rows: pa.Table):
        rows = rows.combine_chunks().to_batches()[0].sort_by("node")
        unit = units(matrix(rows.column("vector"), width))
        sizes = np.diff(rows.column("vector").offsets.to_numpy())
        return rows.column("node").to_numpy(), rows.column("copies").to_numpy(), unit, sizes, Tree(unit @ axes)

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("interval").to_numpy()
        first, last = at.min(), at.max()
        a = sequence(rows.filter(pa.array(at == first)))
        b = a if first == last else sequence(rows.filter(pa.array(at == last)))
        n_a = np.zeros(len(a[0]), dtype=np.int64)
        n_b = n_a if a is b else np.zeros(len(b[0]), dtype=np.int64)
        edges = []
        for i, i_end, j, j_end in near_blocks(a[4], b[4], reach):
            linked = (a[2][i:i_end] @ b[2][j:j_end].T >= cosine) & (a[3][i:i_end, None] == b[3][None, j:j_end])
            if a is b and i == j:
                linked = np.triu(linked, 1)
            if linked.any():
                n_a[i:i_end] += linked @ b[1][j:j_end]
                n_b[j:j_end] += a[1][i:i_end] @ linked
                x, y = forest(linked)
                edges.append((a[0][i + x], b[0][j + y]))
        ends = [np.concatenate([np.zeros(0, dtype=np.int64), *e]) for e in zip(*edges)] if edges else [np.zeros(0, dtype=np.int64)] * 2
        nodes, counts = (a[0], n_a) if a is b else (np.concatenate([a[0], b[0]]), np.concatenate([n_a, n_b]))
        some = counts > 0
        none = pa.nulls
        return pa.table({
            "a": pa.array(np.concatenate([nodes[some], ends[0]])),
            "b": pa.chunked_array([none(int(some.sum()), pa.int64()), pa.array(ends[1])]),
            "n": pa.chunked_array([pa.array(counts[some]), none(len(ends[0]), pa.int64())]),
        })

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, axes: int = AXES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding).

    Vectors of one length at ``cosine`` or more are linked.  n_links counts the other rows linked directly,
    copies included; component_id is the smallest vec_id reachable.  Vectors that are null, zero or hold null
    or non-finite components link with nothing.  Rows that repeat a vec_id count as rows.  Copies of a vector are
    one row in the join.  A null vec_id is never the smallest; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    distinct = stored(rows.filter(usable("vector")).groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "vectors")
    shape = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    alone = rows.filter(~usable("vector")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not shape["n"]:
        return alone.withColumn("kept", F.lit(True))
    width = shape["width"]
    leading = principal_axes(distinct, width)[:, :axes]
    side = (2.0 - 2.0 * cosine) ** 0.5

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grid = np.floor(units(matrix(batch.column("vector"), width)) @ leading / side).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(grid) + 1, dtype=np.int32) * grid.shape[1]), pa.array(grid.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vector", "least", "copies")], lists], names=["vector", "least", "copies", "cells"])

    vector_type = distinct.schema["vector"].dataType.simpleString()
    gridded = distinct.mapInArrow(cells, f"vector {vector_type}, least long, copies long, cells array<int>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shape["n"] // 1_000_000)
    order = [F.col("cells"), F.xxhash64("vector")]  # the hash cuts a cell that holds very many
    lined = stored(gridded.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "sequence")
    counts = sorted((r["part"], r["n"]) for r in lined.groupBy(F.shiftright("node", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = np.cumsum([0, *[n for _, n in counts]])
    first = spark.createDataFrame([(part, int(start)) for (part, _), start in zip(counts, starts)], "part long, start long")
    size = max(INTERVAL, -(-shape["n"] // MOST_INTERVALS))
    placed = stored(
        lined.withColumn("part", F.shiftright("node", 33)).join(first, "part")
        .select("node", "vector", "least", "copies", F.floor((F.col("start") + F.col("node").bitwiseAND(2**33 - 1)) / size).cast("int").alias("interval")),
        "intervals",
    )

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if batch.num_rows:
                along, at = units(matrix(batch.column("vector"), width)) @ leading, batch.column("interval").to_numpy()
                for k in np.unique(at):
                    own = along[at == k]
                    low, high = found.get(k, (own[0], own[0]))
                    found[k] = np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
        rows = [(int(k), axis, float(low[axis]), float(high[axis])) for k, (low, high) in found.items() for axis in range(len(low))]
        yield pa.RecordBatch.from_pylist([dict(zip(("interval", "axis", "low", "high"), r)) for r in rows], pa.schema([("interval", pa.int32()), ("axis", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    seen = placed.mapInArrow(boxes, "interval int, axis int, low double, high double").groupBy("interval", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    total = 1 + max(r["interval"] for r in seen)
    low, high = np.zeros((total, leading.shape[1])), np.zeros((total, leading.shape[1]))
    for r in seen:
        low[r["interval"], r["axis"]], high[r["interval"], r["axis"]] = r["low"], r["high"]
    near = [np.flatnonzero(apart(low[i], high[i], low, high) <= 2.0 - 2.0 * cosine + SLACK) for i in range(total)]
    meets = spark.createDataFrame([(i, [int(min(i, j) * total + max(i, j)) for j in own]) for i, own in enumerate(near)], "interval int, pairs array<long>")
    dealt = placed.join(meets, "interval").select("interval", "node", "vector", "copies", F.explode("pairs").alias("pair"))
    found = stored(dealt.groupBy("pair").applyInArrow(_join_pair(width, leading, cosine), "a long, b long, n long"), "found")
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    linked = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = stored(
        placed.select("node", "least", "copies", "vector").join(linked, "node", "left").join(roots, "node", "left")
        .select("vector", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "named",
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = stored(named.join(smallest, "root").select("vector", "n_links", "component_id"), "answers")
    out = rows.filter(usable("vector")).join(answers, "vector").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
