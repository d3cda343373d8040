"""Line dedup: hashes in range partitions, streamed in order, answered as keep bitmaps.

Lines become (two 64-bit hashes, document, position).  They are range-partitioned by hash with document
(largest first) and position as secondary order, so a line that fills a third of the corpus is cut over
many partitions.  Each partition streams its rows once: inside, a line's first document is known to
be the largest that holds it and the number of documents shows at once.  Only the first and the last line of a
partition may reach into its neighbours; their rows are passed on as open and settled by counts per hash,
two hashes per partition at most.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.plans import skew
from plurality.plans.lineage import stored

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 20
LEAST_DOCS = 3
ROWS_PER_PARTITION = 1_000_000

ROW = ["doc_id", "row_key"]
CARRIED = ("doc_id", "row_key", "n_lines", "position", "h1", "h2")
MARKS = "doc_id long, row_key long, n_lines long, position int, h1 long, h2 long, open boolean"


def _row_key():
    """Tells rows of one doc_id with different texts apart; equal rows share their lines and their bitmap."""
    return F.xxhash64("doc_id", "text")


def long_lines(docs: DataFrame, least_length: int) -> DataFrame:
    """(h1, h2, doc_id, row_key, position) of every line whose key has ``least_length`` code points or more."""
    key = F.translate(F.btrim("line", F.lit(BLANK)), UPPER, LOWER)
    texts = docs.select("doc_id", _row_key().alias("row_key"), F.split("text", "\n", -1).alias("lines"))
    lines = texts.select("doc_id", "row_key", F.size("lines").cast("long").alias("n_lines"), F.posexplode("lines").alias("position", "line"))
    return (
        lines.select("doc_id", "row_key", "n_lines", "position", key.alias("key"))
        .filter(F.length("key") >= least_length)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_key", "n_lines", "position")
    )


def _stream(least_docs: int):
    """Rows of one sorted partition to the rows that go (open false) or that the counts must settle (open true)."""

    def emit(batch: pa.RecordBatch, mask: np.ndarray, open_: bool) -> pa.RecordBatch:
        part = batch.filter(pa.array(mask))
        cols = [part.column(c) for c in CARRIED]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(part.num_rows, open_))], names=[*CARRIED, "open"])

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Whole groups only."""
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        ids = batch.column("doc_id")
        doc, null = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null())
        n = len(h1)
        new_group = np.ones(n, dtype=bool)
        new_group[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_group.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
        group = np.cumsum(new_group) - 1
        docs = np.bincount(group, weights=new_doc)[group]
        nth = np.cumsum(new_doc)
        later = nth > nth[np.flatnonzero(new_group)][group]
        return emit(batch, later & (docs >= least_docs), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, held = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            starts = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            at = [int(x) for x in (starts[0], starts[-1])]
            if first is None:
                first = (h1[0], h2[0])
            if (h1[0], h2[0]) != last and held:
                yield settle(_joined(held))
                held = []
            begin = 0
            if (h1[0], h2[0]) == first:  # the partition's first line: passed on as it comes
                begin = int(starts[1]) if len(starts) > 1 else batch.num_rows
                yield emit(batch.slice(0, begin), np.ones(begin, dtype=bool), True)
            tail = max(at[1], begin)
            if tail > begin:
                held.append(batch.slice(begin, tail - begin))
                yield settle(_joined(held))
                held = []
            if tail < batch.num_rows:
                held.append(batch.slice(tail))
            last = (h1[-1], h2[-1])
        if held:
            end = _joined(held)
            yield emit(end, np.ones(end.num_rows, dtype=bool), True)

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _bitmaps(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups:
        packed = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            keep = np.ones(n, dtype=bool)
            keep[gone] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in (*ROW, "n_lines")], pa.array([len(x) for x in batch.column("gone").to_pylist()], pa.int64()), pa.array(packed, pa.binary())],
            names=[*ROW, "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, keep) of the documents that lose lines.

    A line's key is the line without blanks at both ends and with A-Z lower-cased.  A key of
    ``least_length`` code points or more that occurs in ``least_docs`` different doc_ids or more stays only in
    the largest of them (with all its lines there).  ``keep`` is a zlib-compressed bitmap, first line in the highest bit.
    Null and empty texts hold one empty line and lose nothing.  A null doc_id is one more
    document, smaller than any other.  Rows that repeat a doc_id belong to one document.
    """
    lines = stored(docs.transform(long_lines, least_length), "lines")
    rows = lines.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_PARTITION)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("row_key"), F.col("position")]
    marks = stored(
        lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream(least_docs), MARKS), "marks"
    )
    waiting = marks.filter("open")
    cut = (
        waiting.groupBy("h1", "h2")
        .agg(F.countDistinct(F.struct("doc_id")).alias("_docs"), F.max("doc_id").alias("_last"))
        .filter(F.col("_docs") >= least_docs)
    )
    late = skew.attach(waiting, cut, ["h1", "h2"], ["doc_id", "row_key", "position"], "inner").filter(~F.col("doc_id").eqNullSafe(F.col("_last")))
    own = [*ROW, "n_lines"]
    gone = marks.filter("NOT open").select(*own, "position").unionByName(late.select(*own, "position"))
    per_row = gone.groupBy(*own).agg(F.sort_array(F.collect_set("position")).alias("gone"))
    return per_row.mapInArrow(_bitmaps, "doc_id long, row_key long, n_lines long, n_dropped long, keep binary")


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, row_key) where a null doc_id equals a null doc_id."""
    right = right.withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("row_key", "_row_key")
    on = (F.col("row_key") == F.col("_row_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return left.join(right, on, how).drop("_doc_id", "_row_key")


def _kept(text: str, keep: bytes | None) -> str:
    if keep is None:
        return text or ""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return "\n".join(x for x, bit in zip(lines, bits) if bit)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, n_dropped, keep): each row of ``docs`` as a struct, so that no column name of it matters; keep is null where all lines stay."""
    rows = docs.select(F.struct("*").alias("row"))
    keyed = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.doc_id", "row.text").alias("row_key"))
    return _same_row(keyed, bitmaps.select(*ROW, "n_dropped", "keep"), "left").select("row", "n_dropped", "keep")


@F.pandas_udf(T.StringType())
def kept_text(text, keep):
    """The kept lines, joined by newlines; '' for a null text."""
    import pandas as pd

    return pd.Series([_kept(t, k) for t, k in zip(text, keep)], dtype=object)


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keeps = batch.column("text").to_pylist(), batch.column("keep").to_pylist()
            lines = [(t or "").count("\n") + 1 for t in texts]
            dropped = batch.column("n_dropped").fill_null(0)
            sha = [hashlib.sha256(_kept(t, k).encode()).hexdigest() for t, k in zip(texts, keeps)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), dropped, pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    wide = with_bitmaps(docs.select("doc_id", "text"), bitmaps)
    return wide.select("row.doc_id", "row.text", "n_dropped", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeats(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the kept text; a column n_chars, if there is one, counts the new text. Other columns stay."""
    wide = with_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), least_length, least_docs))
    changed = wide.filter("keep IS NOT NULL").withColumn("text", kept_text("row.text", "keep"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    whole = wide.filter("keep IS NULL").select("row.*")
    return whole.unionByName(changed.select(row.alias("row")).select("row.*"))
