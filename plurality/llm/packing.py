"""Best-fit packing by patterns: few-document length patterns fitted to the length histogram.

Only the histogram of piece lengths (one count per length up to the sequence length) reaches the driver.
There, patterns of few lengths that fill a sequence are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best-fit, largest
first, again as repeated patterns.  The plan says which ranks of which length lie where in which
sequences; pieces are ranked in their length and look their place up.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm import ranks
from plurality.plans.lineage import stored

SEQUENCE = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the added tokens of the vocabulary's ``tokenizers`` file (a test compares them).
ADDED = {"<|endoftext|>": 50256}
TEXTS_AT_ONCE = 256
ROWS_PER_BIN = 25_000  # pieces of one length that a task numbers together


def encoder(ranks_path: str):
    """Token ids of a whole text and the end id.

    The vocabulary is read as ranks: the ids are those of the same vocabulary in ``tokenizers`` (a test compares
    them), at several times the speed.  As there, strings of ``ADDED`` tokens in a text are those tokens.
    """
    import tiktoken

    with open(ranks_path, "rb") as file:
        vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    one = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens=ADDED)
    return lambda text: np.array([*one.encode(text, allowed_special="all"), END_ID], dtype="<u4")


def cut(n_ids: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or whole sequences after a first piece with the rest."""
    first = n_ids % sequence or sequence
    return [(0, first), *[(s, sequence) for s in range(first, n_ids, sequence)]]


def pieces(docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document as ids and an end id, cut to the sequence length.

    ``ranks_path`` is a byte-level vocabulary as ranks, found on every executor.  A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text or "")
                    rows += [(doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())) for i, (start, n) in enumerate(cut(len(ids), sequence))]
                columns = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def repeat_counts(shapes: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 whose lengths, patterns times x, come nearest the histogram.

    A length's error counts by its tokens, as long pieces are the harder ones to place afterwards.
    Accelerated projected gradient steps on the sparse pattern matrix.
    """
    at = np.array([n for shape in shapes for n in shape])
    of = np.repeat(np.arange(len(shapes)), [len(shape) for shape in shapes])
    size, scale = len(counts), max(1.0, float(counts.max()))
    goal, weight = counts / scale, (np.arange(size) / size) ** 2
    widest = np.bincount(at, weights=weight[at], minlength=size).max() * max(map(len, shapes))
    x = y = np.zeros(len(shapes))
    momentum = 1.0
    for _ in range(rounds):
        error = weight * (np.bincount(at, weights=y[of], minlength=size) - goal)
        new = np.maximum(0.0, y - np.bincount(of, weights=error[at], minlength=len(shapes)) / widest)
        faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y, x, momentum = new + (momentum - 1) / faster * (new - x), new, faster
    return x * scale


def patterns(counts: np.ndarray, sequence: int, partners: int = 3) -> list[tuple[int, ...]]:
    """Few-document patterns, longest length first, that fill a sequence as far as the lengths at hand allow.

    For each length: with the lengths nearest below what is left, alone and with one more that fills the rest.
    """
    present = np.flatnonzero(counts)
    found = set()
    for length in present[::-1].tolist():
        rest = sequence - length
        below = present[present <= min(rest, length)][::-1]
        if not len(below):
            found.add((length,))
            continue
        spread = np.unique(np.linspace(0, len(below) - 1, 2 * partners).astype(int))
        for second in {*below[:partners].tolist(), *below[spread].tolist()}:
            left = rest - second
            third = present[present <= min(left, second)]
            if len(third):
                fourth = present[present <= min(left - third[-1], third[-1])]
                found.add((length, second, int(third[-1]), *([int(fourth[-1])] if len(fourth) else [])))
            else:
                found.add((length, second))
    return sorted(found, reverse=True)


def best_fit(left: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """The residual, best-fit with the largest first; equal sequences are made at once, so the work follows the histogram."""
    left, out = left.copy(), []
    while left.any():
        room, taken = sequence, {}
        while room > 0:
            fits = np.flatnonzero(left[1 : room + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            many = min(room // length, int(left[length]))
            taken[length] = many
            left[length] -= many
            room -= many * length
        repeats = 1 + min(int(left[n]) // k for n, k in taken.items())
        for n, k in taken.items():
            left[n] -= (repeats - 1) * k
        out.append((tuple(n for n, k in taken.items() for _ in range(k)), repeats))
    return out


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once."""
    counts = np.zeros(sequence + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = [((sequence,), int(counts[sequence]))] if counts[sequence] else []
    counts[sequence] = 0
    shapes = [shape for shape in patterns(counts, sequence) if sum(shape) == sequence]
    if shapes:
        fitted = repeat_counts(shapes, counts)
        for j in np.argsort(-fitted, kind="stable"):
            need = {n: shapes[j].count(n) for n in shapes[j]}
            repeats = min(int(fitted[j] + 1e-9), *[int(counts[n]) // k for n, k in need.items()])
            if repeats > 0:
                out.append((shapes[j], repeats))
                for n, k in need.items():
                    counts[n] -= k * repeats
    return out + best_fit(counts, sequence)


def places(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): one row per slot of a pattern."""
    out, used, sequence_id = [], {}, 0
    for shape, repeats in made:
        offset = 0
        for length in shape:
            start = used.get(length, 0)
            out.append((length, start, repeats, sequence_id, offset))
            used[length] = start + repeats
            offset += length
        sequence_id += repeats
    return out


def pack(docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE, seed: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null and empty texts are one end id.  Rows that repeat a doc_id are packed each.
    Pieces of one length are interchangeable, so their order follows a hash and reruns agree up to equal rows.
    A piece of full length is a sequence of its own, numbered below zero where it lies: it is neither ranked nor moved.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, ranks_path, sequence), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram.pop(sequence, None)
    bits = max(8, (max(histogram.values(), default=0) // ROWS_PER_BIN).bit_length())
    slots = spark.createDataFrame(
        places(plan(histogram, sequence)), "_length long, _first long, _many long, _sequence long, offset long"
    )
    hashed = rows.filter(F.col("length") < sequence).withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32", "start"))
    ranked = ranks.gapless(hashed, ["length"], "_order", "_rank", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], bits=bits)
    by_length = slots.groupBy("_length").agg(F.sort_array(F.collect_list(F.struct("_first", "_many", "_sequence", "offset"))).alias("_slots"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shared = (
        ranked.join(F.broadcast(by_length), F.col("length") == F.col("_length"))  # one row per length, slots bounded by the plan
        .withColumn("_slot", F.filter("_slots", lambda s: (s["_first"] <= F.col("_rank")) & (F.col("_rank") < s["_first"] + s["_many"]))[0])
        .select(*own, (F.col("_slot._sequence") + F.col("_rank") - F.col("_slot._first")).alias("sequence_id"), F.col("_slot.offset").alias("offset"))
    )
    full = rows.filter(F.col("length") == sequence).select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(full)
