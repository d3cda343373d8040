"""SimHash near-duplicates by multi-index hashing.

Distinct fingerprints are cut into segments.  Two fingerprints at most k bits apart agree, in one of the
segments, up to a small number of bits (by the pigeonhole rule), so the Hamming ball of that radius around
each segment value is enumerated, the tables are asked for those values, and the whole distance of what they hold is verified.

A table value that very many fingerprints share (thousands of near copies differ in few bits) would give
pairs in the square of their number.  Those fingerprints, all of them, meet in another table instead: each
enumerates the ball of radius k/2 around the whole fingerprint; two are linked if and only if their balls share a
point, so each point links what it holds to its smallest fingerprint, and the rows stay in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.graph import components
from plurality.plans.lineage import stored

SHINGLE = 4
SEED = 42
BITS = 64
MOST_BITS = 4
#: Fingerprints that one table value may hold before they are linked by whole balls.
CROWD = 64
SPARSE = 8.0


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text; 0 where there is no word.

    A-Z is lower-cased; words are runs of other bytes than blank, tab, newline, vertical tab, form feed and return.
    """
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = np.array(hashes[at : at + 65_536], dtype=">u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the lowest ``bits`` bits."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)]


def segments(parts: int, most_bits: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    With k = parts * r + a, one of the first a + 1 segments differs in r bits at most or one of the others in r - 1.
    """
    r, a = divmod(most_bits, parts)
    width, wide = divmod(BITS, parts)
    out, shift = [], 0
    for i in range(parts):
        own = width + (i < wide)
        radius = r if i <= a else r - 1
        if radius >= 0:
            out.append((shift, own, radius))
        shift += own
    return out


def parts_for(distinct: int, most_bits: int) -> int:
    """Segments that make the work per fingerprint least: values asked for plus fingerprints they are expected to hold."""

    def work(parts: int) -> float:
        return sum(len(ball(w, r)) * (1 + distinct / 2.0**w * SPARSE) for _, w, r in segments(parts, most_bits))

    return min(range(2, max(2, most_bits) + 1), key=work)


def links(fps: DataFrame, most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect exactly what pairs within ``most_bits`` bits connect."""
    layout = segments(parts_for(fps.count(), most_bits), most_bits)

    def value(shift: int, width: int):
        return F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)

    def number(masks: list[int]):
        return F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))

    table = [fps.select(F.lit(i).alias("part"), value(s, w).alias("value"), "fp") for i, (s, w, _) in enumerate(layout)]
    asked = [
        fps.select(value(s, w).alias("own"), "fp", number(ball(w, r)).alias("mask")).select(F.lit(i).alias("part"), F.col("own").bitwiseXOR(F.col("mask")).alias("value"), F.col("fp").alias("other"))
        for i, (s, w, r) in enumerate(layout)
    ]
    table, asked = stored(_union(table), "tables"), _union(asked)  # Spark sizes ``asked`` like ``fps``, though it has tens of rows for each
    crowded = stored(table.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("part", "value"), "crowded")
    thin = table.join(crowded, ["part", "value"], "left_anti")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    near = thin.join(asked.hint("merge"), ["part", "value"]).filter((F.col("fp") < F.col("other")) & (apart <= most_bits)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if crowded.isEmpty():
        return near
    members = stored(asked.join(crowded, ["part", "value"], "left_semi").select(F.col("other").alias("fp")).distinct(), "members")
    return near.unionByName(_ball_links(members, most_bits))


def _ball_links(members: DataFrame, most_bits: int) -> DataFrame:
    """Star edges through shared points of the balls around whole fingerprints.

    For an odd distance the balls of the larger half would reach one bit too far, so pairs are refused there.
    """
    if most_bits % 2:
        raise ValueError("linking through shared points needs an even number of bits")
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in ball(BITS, most_bits // 2)]
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in signed]))
    points = members.select("fp", mask.alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp")
    linked = points.select("fp", F.first("fp").over(Window.partitionBy("point").orderBy("fp")).alias("hub"))
    return linked.filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Fingerprints at ``most_bits`` differing bits or fewer are linked; component_id is the smallest doc_id reachable.
    Null and empty texts and texts of blanks have fingerprint zero, linked like any other.  Rows that repeat a
    doc_id are rows of their own with the same id.  A null doc_id is never the smallest unless its component
    holds no other; then component_id is null.  An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = stored(components(links(groups.select("fp"), most_bits)), "roots")
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stored(rooted.join(named, "root").select("fp", "component_id"), "components")
    unsigned = F.lower(F.lpad(F.hex("fp"), BITS // 4, "0"))
    return rows.join(by_fp, "fp").select("doc_id", unsigned.alias("fingerprint"), "component_id")
