"""CSV files with line breaks inside quoted fields, read in as many tasks as the file has blocks.

Whether a block of bytes begins inside a quoted field depends on all quotes before it.  So every block counts its
quotes first; the parities are scanned over the blocks, one small row each; then each block knows its state and cuts
its own lines into records.  Only the piece of a record that crosses a block border meets the other pieces.

Quotes stand as RFC 4180 has them: a field that holds a quote, a separator or a line break is quoted, and quotes inside
are doubled, so their number decides.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces that cross a border, in order of their place in a block: the end of an earlier record, the beginning of the next.
WHOLE, END, BEGIN = 0, 1, 2
RECORDS = "file string, block long, place long, piece int, text string"


@contextmanager
def block_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Files read to the end inside are cut into blocks of about ``size`` bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value): every line with the block of bytes that it begins in; return characters stay."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value")


def entry_states(found: DataFrame) -> DataFrame:
    """(file, block, inside): whether a block begins inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    parity = found.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parity.select("file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int").alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole blocks, in order, to records; the first and the last piece of a block may belong to other blocks' records."""
    at, inside, held, begun, place = None, False, [], False, 0
    out: list[tuple] = []

    def close(last: bool) -> None:
        nonlocal held, begun, place
        if held or begun:
            kind = BEGIN if begun and last and inside else WHOLE if begun else END
            out.append((*at, place, kind, "\n".join(held)))
            place += 1
        held, begun = [], False

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "place", "piece", "text"])

    for batch in batches:
        for file, block, entry, value in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "inside", "value")]):
            if (file, block) != at:
                close(True)
                at, inside, place = (file, block), bool(entry), 0
            if not inside:
                close(False)
                begun = True
            held.append(value)
            if value.count('"') % 2:
                inside = not inside
        yield flushed()
    close(True)
    yield flushed()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, text): one row per record of the files at ``path``; (block, place) keeps the order of a file.  Blank records are left out."""
    found = lines(spark, path)
    known = found.join(entry_states(found), ["file", "block"]).sortWithinPartitions("file", "block", "nth")
    pieces = known.select("file", "block", "inside", "value").mapInArrow(_cut, RECORDS)
    # per block at most one end and one beginning: a small table
    order = Window.partitionBy("file").orderBy("block", "place")
    broken = pieces.filter(F.col("piece") != WHOLE).withColumn("owner", F.sum((F.col("piece") == BEGIN).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    mended = broken.groupBy("file", "owner").agg(parts.alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["place"].alias("place"), F.array_join(F.col("parts.text"), "\n").alias("text")
    )
    whole = pieces.filter(F.col("piece") == WHOLE).select("file", "block", "place", "text").unionByName(mended)
    return whole.withColumn("text", F.regexp_replace("text", "\r$", "")).filter(F.trim("text") != "")


def _is_header() -> Column:
    return (F.col("block") == 0) & (F.col("place") == 0)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first record; only the lines it needs are read."""
    first, wanted = lines(spark, path).filter("block = 0").select("value"), 1
    while True:
        found = [r["value"] for r in first.take(wanted)]
        text = "\n".join(found)
        if text.count('"') % 2 == 0 and found:
            return next(csv.reader(io.StringIO(text.removeprefix("\ufeff").rstrip("\r"), newline="")))
        if len(found) < wanted:
            raise ValueError(f"no header in {path}")
        wanted += 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of CSV files with a header, all columns as text; unquoted empty fields are null, as Spark's own reader has them.

    The files at ``path`` share one header.  A record of fewer fields ends in nulls, fields beyond the header are dropped.
    """
    names = header(spark, path)
    places = [f"_{i}" for i in range(len(names))]
    parsed = F.from_csv("text", ", ".join(f"{p} string" for p in places), {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    rows = records(spark, path).filter(~_is_header()).select(parsed.alias("row"))
    return rows.select(*[F.col(f"row.{p}").alias(n) for p, n in zip(places, names)])
