"""Bootstrap intervals as partial sums.

Every record draws a Poisson(1) weight per replicate from a hash of its id, so the
resample does not depend on how rows are partitioned and a re-run gives the same digits.
Rows are dealt evenly over the tasks.  A task adds up the groups of which it holds many rows, with a slot per
replicate, and hands on the few rows of others as they are, so what moves is bounded by the rows; one task then
finishes each group and hands on its summary only.  The n x B weights exist only in small blocks inside a task.
numpy-style index resampling is matched in distribution, not digit by digit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import keys

# Multipliers of the 32-bit finalizer that mixes record hash and replicate number (fixed values).
REPLICATE_STEP = 0x9E3779B9
MIX_A = 0x85EBCA6B
MIX_B = 0xC2B2AE35

#: Rows of a group that a task hands on one by one before it adds them up, and groups that it adds up at once.
FEW, SUMS_AT_ONCE = 256, 500
#: Groups that a task remembers the number of rows of; then it starts to count anew.
COUNTED = 100_000
ROWS_AT_ONCE = 64
PARTS = pa.schema(
    [
        ("_group", pa.string()),
        ("hash", pa.list_(pa.int64())),
        ("value", pa.list_(pa.float64())),
        ("aside", pa.list_(pa.float64())),
        ("w", pa.list_(pa.float64())),
        ("wx", pa.list_(pa.float64())),
        ("below", pa.float64()),
        ("also", pa.list_(pa.float64())),
    ]
)
PARTS_DDL = "_group string, hash array<bigint>, value array<double>, aside array<double>, w array<double>, wx array<double>, below double, also array<double>"


def poisson_cuts(levels: int = 9) -> list[int]:
    """Cumulative Poisson(1) probabilities on a 16-bit scale."""
    total, cuts = 0.0, []
    for k in range(levels):
        total += math.exp(-1.0) / math.factorial(k)
        cuts.append(int(total * 65536))
    return cuts


def _weights(hashes: np.ndarray, replicates: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    x = hashes[:, None] ^ (replicates * np.uint32(REPLICATE_STEP))[None, :]
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX_A)
    x ^= x >> np.uint32(13)
    x *= np.uint32(MIX_B)
    x ^= x >> np.uint32(16)
    return lookup[x & np.uint32(0xFFFF)]  # unsigned arithmetic wraps, which is what the mixing wants


class _Sums:
    """Sums of one group over all slots; slot 0 has weight one for every row."""

    def __init__(self, n_boot: int, n_also: int):
        self.w, self.wx, self.below, self.also = np.zeros(n_boot + 1), np.zeros(n_boot + 1), 0.0, np.zeros(n_also)

    def add_rows(self, hashes: np.ndarray, values: np.ndarray, also: np.ndarray, replicates: np.ndarray, lookup: np.ndarray) -> None:
        self.w[0] += len(values)
        self.wx[0] += values.sum()
        self.below += float((values < 0).sum())
        self.also += also.reshape(len(values), -1).sum(axis=0) if len(self.also) else 0.0
        for at in range(0, len(values) if len(replicates) else 0, ROWS_AT_ONCE):
            block = _weights(hashes[at : at + ROWS_AT_ONCE].astype(np.uint32), replicates, lookup)
            self.w[1:] += block.sum(axis=0)
            self.wx[1:] += np.einsum("i,ij->j", values[at : at + ROWS_AT_ONCE], block)

    def add(self, w: np.ndarray, wx: np.ndarray, below: float, also: np.ndarray) -> None:
        self.w += w
        self.wx += wx
        self.below += below
        self.also += also

    def means(self) -> np.ndarray:
        """Resampled means in order of the replicates; nan where no record was drawn."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.wx[1:] / self.w[1:]


def _lookup() -> np.ndarray:
    return np.searchsorted(np.array(poisson_cuts()), np.arange(65536), side="right").astype(np.float64)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, type=kind))


def _partial_sums(n_boot: int, n_also: int):
    """Per task: the rows of a group as lists while the task met few of them, then sums of all slots."""

    def emit(sums: dict) -> pa.RecordBatch:
        rows = [(name, [], [], [], s.w, s.wx, s.below, s.also) for name, s in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PARTS)], schema=PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, replicates = _lookup(), np.arange(n_boot, dtype=np.uint32)
        sums: dict = {}
        seen: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            group = pa.array(batch.column("_group")).dictionary_encode()
            order = np.argsort(group.indices.to_numpy(zero_copy_only=False), kind="stable")
            names = group.dictionary.to_pylist()
            sizes = np.bincount(group.indices.to_numpy(zero_copy_only=False), minlength=len(names))
            ends = np.cumsum(sizes)
            hashes = batch.column("_hash").to_numpy(zero_copy_only=False)[order]
            values = batch.column("_value").to_numpy(zero_copy_only=False)[order]
            also = batch.column("_also").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_also)[order]
            single = np.ones(len(names), dtype=bool)
            for code, (name, size) in enumerate(zip(names, sizes.tolist())):
                seen[name] = seen.get(name, 0) + size
                if seen[name] > FEW:
                    single[code] = False
                    mine = slice(ends[code] - size, ends[code])
                    if name not in sums:
                        sums[name] = _Sums(n_boot, n_also)
                    sums[name].add_rows(hashes[mine], values[mine], also[mine], replicates, lookup)
                    if len(sums) >= SUMS_AT_ONCE:
                        yield emit(sums)
                        sums = {}
            if single.any():
                rows, lengths = np.repeat(single, sizes), sizes[single]
                none = _lists(np.empty(0), 0 * lengths, pa.float64())
                columns = [
                    group.dictionary.filter(pa.array(single)),
                    _lists(hashes[rows], lengths, pa.int64()),
                    _lists(values[rows], lengths, pa.float64()),
                    _lists(also[rows].ravel(), lengths * n_also, pa.float64()),
                    none,
                    none,
                    pa.array(np.zeros(len(lengths))),
                    none,
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=PARTS)
            if len(seen) > COUNTED:
                seen = dict.fromkeys(sums, FEW)
        if sums:
            yield emit(sums)

    return run


def _whole(batches: Iterator[pa.RecordBatch], n_boot: int, n_also: int) -> Iterator[tuple[str, _Sums]]:
    """The sums of each group from parts sorted by group; one group's are held at a time."""
    lookup, replicates = _lookup(), np.arange(n_boot, dtype=np.uint32)
    name, held, hashes, values, aside = None, None, [], [], []

    def settle() -> None:
        if hashes:
            held.add_rows(np.concatenate(hashes), np.concatenate(values), np.concatenate(aside), replicates, lookup)
            for x in (hashes, values, aside):
                x.clear()

    for batch in batches:
        columns = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in ("hash", "value", "aside", "w", "wx", "also")}
        for i, (group, below) in enumerate(zip(batch.column("_group").to_pylist(), batch.column("below").to_pylist())):
            part = {c: x[at[i] : at[i + 1]] for c, (at, x) in columns.items()}
            if held is None or group != name:
                if held is not None:
                    settle()
                    yield name, held
                name, held = group, _Sums(n_boot, n_also)
            if len(part["w"]):
                held.add(part["w"], part["wx"], below, part["also"])
            else:
                for x, c in ((hashes, "hash"), (values, "value"), (aside, "aside")):
                    x.append(part[c])
                if len(hashes) >= ROWS_AT_ONCE:
                    settle()
    if held is not None:
        settle()
        yield name, held


def _finished(finish, kind: pa.Schema, n_boot: int, n_also: int, at_once: int = 1024):
    """Batches of ``finish(sums)``, a tuple of the fields after the group's name."""

    def pack(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list = []
        for name, sums in _whole(batches, n_boot, n_also):
            done.append((name, *finish(sums)))
            if len(done) >= at_once:
                yield pack(done)
                done = []
        if done:
            yield pack(done)

    return run


def _replicates(
    df: DataFrame, groups: Sequence[str], value: str, n_boot: int, seed: int, id_column: str, also: Sequence[str] = ()
) -> DataFrame:
    """Parts of sums, every group's in one partition and next to each other."""
    spark = df.sparkSession
    named = F.to_json(F.struct(*groups)) if groups else F.lit("{}")
    rows = df.filter(F.col(value).isNotNull()).select(
        named.alias("_group"),
        keys.hash32(F.lit(str(seed)), F.col(id_column)).alias("_hash"),
        F.col(value).cast("double").alias("_value"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in also]).cast("array<double>").alias("_also"),
    )
    # a stated number, or adaptive execution would leave these few bytes to few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    even = rows.repartition(tasks, "_hash", "_value")
    parts = even.mapInArrow(_partial_sums(n_boot, len(also)), PARTS_DDL)
    return parts.repartition(tasks, "_group").sortWithinPartitions("_group")


def _named(df: DataFrame, source: DataFrame, groups: Sequence[str], *columns) -> DataFrame:
    if not groups:
        return df.select(*columns)
    back = F.from_json("_group", source.select(*groups).schema)
    return df.select(*[back[g].alias(g) for g in groups], *columns)


def _quantile(ordered: np.ndarray, q: float) -> float | None:
    """Linear interpolation in a sorted array; null for an empty one."""
    if not len(ordered):
        return None
    place = q * (len(ordered) - 1)
    low = math.floor(place)
    a, b = float(ordered[low]), float(ordered[math.ceil(place)])
    return a + (place - low) * (b - a)


def replicate_means(
    df: DataFrame, groups: Sequence[str], value: str, n_boot: int = 2000, seed: int = 0, id_column: str = "record_id"
) -> DataFrame:
    """(groups, replicate, mean) of the resampled means."""
    parts = _replicates(df, groups, value, n_boot, seed, id_column)

    def finish(sums: _Sums) -> tuple:
        return (pa.array(sums.means(), mask=sums.w[1:] == 0),)

    kind = pa.schema([("_group", pa.string()), ("means", pa.list_(pa.float64()))])
    means = parts.mapInArrow(_finished(finish, kind, n_boot, 0, at_once=64), "_group string, means array<double>")
    return _named(means.select("_group", F.posexplode("means").alias("replicate", "mean")), df, groups, "replicate", "mean")


def bootstrap_ci(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 0,
    id_column: str = "record_id",
    also: Sequence[str] = (),
) -> DataFrame:
    """n, mean, percentile interval and share below zero per group, in one pass over the rows; there may be any number of groups.

    ``also`` names further columns whose plain means are wanted for the same groups.
    """
    groups = list(groups)
    parts = _replicates(df, groups, value, n_boot, seed, id_column, also)

    def finish(sums: _Sums) -> tuple:
        n, ordered = sums.w[0], np.sort(sums.means()[sums.w[1:] != 0])
        return int(n), float(sums.wx[0] / n), _quantile(ordered, alpha / 2), _quantile(ordered, 1 - alpha / 2), sums.below / n, sums.also / n

    kind = pa.schema([("_group", pa.string()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("mean", "ci_low", "ci_high", "below_zero")], ("also", pa.list_(pa.float64()))])
    ddl = "_group string, n bigint, mean double, ci_low double, ci_high double, below_zero double, also array<double>"
    out = parts.mapInArrow(_finished(finish, kind, n_boot, len(also)), ddl)
    out = out.select("*", *[F.get("also", F.lit(i)).alias(f"_also{i}") for i in range(len(also))]).drop("also").withColumnsRenamed({f"_also{i}": c for i, c in enumerate(also)})
    return _named(out, df, groups, "n", "mean", "ci_low", "ci_high", "below_zero", *also)


def noise_scale(
    df: DataFrame, groups: Sequence[str], value: str, multiplier: float = 1.0, n_boot: int = 2000, seed: int = 0
) -> DataFrame:
    """``multiplier`` times the spread of the resampled means: the smallest difference worth believing."""
    means = replicate_means(df, groups, value, n_boot, seed)
    return means.groupBy(*groups).agg((F.lit(multiplier) * F.stddev_pop("mean")).alias("eta"))
