"""Substring search by an index: many patterns at once against texts that are read once.

Every text gets a place (block, offset); blocks hold up to ``TEXTS_PER_BLOCK`` texts.  The index lists, for each run of three
characters and each block, the offsets of the texts that hold it, so the list of a gram that most texts hold is cut over
all blocks.  A search intersects the lists of a pattern's rarest grams block by block and verifies what is left on the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.plans.lineage import stored

TEXTS_PER_BLOCK = 2048
CHARS_PER_BLOCK = 1 << 24  # a block of long texts ends earlier, so that what a task holds is bounded
GRAM = 3
RAREST = 6  # grams of a pattern that are looked up; what they leave is verified on the text, so results do not depend on it
PAD = "\x00" * GRAM  # every position of a text starts a gram, so patterns below three characters are prefixes of grams
LISTS = pa.schema([("block", pa.int64()), ("gram", pa.string()), ("offsets", pa.list_(pa.int32())), ("held", pa.int32()), ("keys", pa.list_(pa.int64()))])
LISTS_DDL = "block bigint, gram string, offsets array<int>, held int, keys array<bigint>"


def grams(text: Column) -> Column:
    """Distinct runs of three characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _held(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams of padded texts, how many texts hold each, and the offsets of these texts, gram by gram."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    used = np.zeros(0x110000, dtype=bool)
    used[points] = True
    alphabet, n = np.flatnonzero(used), len(texts)
    letters = np.cumsum(used)[points].astype(np.int64) - 1
    runs = (letters[:-2] * len(alphabet) + letters[1:-1]) * len(alphabet) + letters[2:]
    sizes = np.array([len(t) for t in texts])
    whole = np.ones(len(points), dtype=bool)
    for back in range(1, GRAM):  # runs that reach into the next text
        whole[np.cumsum(sizes) - back] = False
    whole = whole[: len(runs)]
    offsets = np.repeat(np.arange(n), sizes)[: len(runs)][whole]
    runs, names = runs[whole], None
    if len(alphabet) ** GRAM * n >= 1 << 63:
        names, runs = np.unique(runs, return_inverse=True)
    pairs = np.sort(runs * n + offsets)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    runs, offsets = np.divmod(pairs, n)
    starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    held = np.diff(np.append(starts, len(runs)))
    runs = runs[starts] if names is None else names[runs[starts]]
    first, last = np.divmod(runs, len(alphabet) ** 2)
    spelled = alphabet[np.stack([first, *np.divmod(last, len(alphabet))], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    return [spelled[i : i + GRAM] for i in range(0, len(spelled), GRAM)], held, offsets


def _block(block: int, texts: list[str], keys: list[int]) -> pa.RecordBatch:
    """The lists of one block, and in a last row without a gram the keys of its texts by offset."""
    names, held, offsets = _held(texts)
    ends = np.concatenate([[0], np.cumsum(held)])
    rows = len(names) + 1
    columns = [
        pa.array(np.full(rows, block, dtype=np.int64)),
        pa.array([*names, None], type=pa.string()),
        pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1]), type=pa.int32()), pa.array(offsets, type=pa.int32())),
        pa.array(np.append(held, 0), type=pa.int32()),
        pa.array([None] * len(names) + [keys], type=pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=LISTS)


def _lists(per_block: int, chars: int):
    """Per task: its texts cut into blocks in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        texts, keys, many = [], [], 0
        for batch in batches:
            for text, key in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("key").to_pylist()):
                texts.append(text.decode("utf-8", "replace"))
                keys.append(key)
                many += len(texts[-1])
                if len(texts) >= per_block or many >= chars:
                    yield _block(block, texts, keys)
                    block, texts, keys, many = block + 1, [], [], 0
        if texts:
            yield _block(block, texts, keys)

    return run


@dataclass(frozen=True)
class Index:
    texts: DataFrame  # id, text, key: the source, read again
    places: DataFrame  # key of each (block, offset)
    postings: DataFrame  # offsets of each (block, gram)
    known: DataFrame  # texts that hold each gram


def build(rows: DataFrame, id: str, text: str) -> Index:
    """Index of ``text`` (case ignored) by ``id``; null texts are found by nothing.  Repeated rows are found each.

    Texts are moved once, to the task that cuts them into blocks and makes their lists.  Lists and places are written in one
    pass, so it does not matter which texts share a block; ``rows`` is read again to verify what a search finds.
    """
    spark = rows.sparkSession
    texts = rows.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    blocks = texts.count() // TEXTS_PER_BLOCK
    tasks = max(spark.sparkContext.defaultParallelism, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    spread = texts.select("key", "text").repartition(tasks, "key").select("key", F.concat(F.lower("text"), F.lit(PAD)).alias("text"))
    lists = stored(spread.mapInArrow(_lists(TEXTS_PER_BLOCK, CHARS_PER_BLOCK), LISTS_DDL), "postings")
    places = lists.filter("gram IS NULL").select("block", F.posexplode("keys").alias("offset", "key"))
    postings = lists.filter("gram IS NOT NULL").select("block", "gram", "offsets")
    known = stored(lists.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("held").alias("held")), "grams")
    return Index(texts, places, postings, known)


def search(index: Index, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, id) of every text that contains the pattern, ignoring case: each pair once per row of the indexed table.

    ``patterns`` is a table; repeated patterns count once, nulls find nothing, the empty pattern finds every text.
    """
    wanted = patterns.filter(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct().withColumn("low", F.lower("pattern"))
    whole = wanted.filter(F.length("low") >= GRAM).withColumn("_grams", grams(F.col("low")))
    whole = whole.select("pattern", "low", F.explode("_grams").alias("gram")).join(index.known, "gram", "left")
    rare = F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram"))), 1, RAREST)
    whole = whole.groupBy("pattern", "low").agg(rare.alias("_rare")).select("pattern", "low", F.size("_rare").alias("need"), F.explode("_rare.gram").alias("gram"))
    starts = F.array(*[F.substring("gram", 1, n) for n in range(GRAM)])
    known = index.known.select("gram", F.explode(F.array_distinct(starts)).alias("low"))
    short = wanted.filter(F.length("low") < GRAM).join(known, "low").select("pattern", "low", F.lit(0).alias("need"), "gram")
    lists = (
        stored(whole.unionByName(short), "wanted")  # written, so that the join knows its size
        .join(index.postings, "gram")
        .groupBy("pattern", "low", "need", "block")
        .agg(F.collect_list("offsets").alias("lists"))
        .filter((F.col("need") == 0) | (F.size("lists") == F.col("need")))
    )
    shared = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists"), F.lit(1))), F.col("lists")[0], F.array_intersect)
    hits = lists.select("pattern", "low", "block", F.explode(F.when(F.col("need") == 0, F.array_distinct(F.flatten("lists"))).otherwise(shared)).alias("offset"))
    named = F.xxhash64("pattern").alias("named")  # spelled out again beside the text: long patterns are not moved with every hit
    keys = hits.select(named, "block", "offset").join(index.places, ["block", "offset"]).groupBy("key").agg(F.collect_set("named").alias("_named"))
    held = index.texts.join(stored(keys, "hits"), "key").select("id", F.lower("text").alias("text"), F.explode("_named").alias("named"))  # lower case once a text
    return held.join(wanted.select("pattern", "low", named), "named").filter(F.contains("text", F.col("low"))).select("pattern", "id")
