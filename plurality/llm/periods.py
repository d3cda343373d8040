"""Periodic runs of words by internal pattern matching.

Documents are laid end to end, words as numbers that differ between documents.  Prefix doubling ranks all stretches of 1, 2, 4, ... words;
the last ranks are the suffix array, and a stretch of 2^k words is an interval of it.  Every block of 2^k words at a multiple of 2^k
asks a wavelet tree over the suffix array for its occurrences (range successors) in the window of starts [P + 2^k, P + 2^(k+1)),
the smallest block also in the window before.  Occurrences of a block in such a window are one arithmetic progression.  Its members' distances
from the block are the candidate periods; of three or more members, which lie in one stretch of the progression's own short period, only the
distances that bring the ends, or the beginnings, of the two stretches of that period together.

Nothing is missed.  A run of period q and length max(LEAST, 3 q) holds, with its shift by q, an aligned block of the
largest 2^k <= max(q, SMALLEST), as 2 * 2^k - 1 + q fits into the run; so the shifted block is in a window.  With three or more members and
short period r, the block's stretch of period r ends before both periods could hold for q + r words (else q would not be the smallest);
if neither its begin nor its end were shifted by q inside the run, both periods would hold for 2 q words.  Every candidate is then
extended both ways by comparing ranks, which gives the whole run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 24, 3
#: log2 of the smallest block; 3 * 2^k <= LEAST lets it stand for every smaller period.
SMALLEST = 3
#: Words of documents that are laid end to end (a longer document stands alone).
TOGETHER = 1 << 16


def doubled(first: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranks of the stretches of 2^k words for k = 0, 1, ..., suffix array).

    ``first`` numbers the words; no word of one document equals one of another.  ``end`` is where a position's document ends.  A rank is the place
    of the first suffix that begins with the stretch, so equal ranks are equal stretches.  Stretches that reach beyond their
    document are unlike all others.  The last ranks are all different.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    keys, slots, rank = first[order], np.arange(n), np.empty(n, dtype=np.int64)
    ranks, size = [], 1
    while True:
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        begins = np.flatnonzero(new)
        rank[order[slots]] = slots[begins][np.cumsum(new) - 1]
        ranks.append(rank.copy())
        many = np.diff(np.append(begins, len(keys)))
        slots = slots[np.repeat(many > 1, many)]  # only stretches that occur again are told apart further
        if not len(slots):
            return ranks, order
        at = order[slots]
        later = at + size
        keys = rank[at] * (n + 1) + np.where(later < end[at], rank[np.minimum(later, n - 1)] + 1, 0)
        by_key = np.argsort(keys, kind="stable")
        keys, order[slots] = keys[by_key], at[by_key]
        size *= 2


class Wavelet:
    """Bits of the values, most significant first, each level stably parted by the bit above (a wavelet matrix)."""

    def __init__(self, values: np.ndarray):
        self.bits, self.zeros = int(len(values)).bit_length(), []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values at [low, high) are smaller than ``bound``."""
        found = np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b, one = zeros[low], zeros[high], (bound >> bit) & 1 == 1
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k among those at [low, high); with k = below(bound), the successor of ``bound``."""
        found = np.zeros(len(low), dtype=np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            found += np.where(one, 1 << bit, 0)
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found


class Text:
    """Documents laid end to end, ready to compare their stretches."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        self.begin, self.end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        document = np.repeat(np.arange(len(sizes)), sizes)
        self.ranks, self.suffixes = doubled(document * (int(words.max(initial=0)) + 1) + words, self.end)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For how many words the texts from i and from j (one document, i < j) agree."""
        i, j, end, agree = i.copy(), j.copy(), self.end[i], np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            size, rank = 1 << k, self.ranks[k]
            more = np.flatnonzero(j + size <= end)
            more = more[rank[i[more]] == rank[j[more]]]
            i[more] += size
            j[more] += size
            agree[more] += size
        return agree

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For how many words the texts before i and before j agree."""
        i, j, begin, agree = i.copy(), j.copy(), self.begin[i], np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            size, rank = 1 << k, self.ranks[k]
            more = np.flatnonzero(i - size >= begin)
            more = more[rank[i[more] - size] == rank[j[more] - size]]
            i[more] -= size
            j[more] -= size
            agree[more] += size
        return agree

    def blocks(self) -> np.ndarray:
        """Columns (place, begin and end in the suffix array, begin and end of the window) of the aligned blocks that occur again."""
        found = []
        for k in range(SMALLEST, len(self.ranks)):
            size, rank = 1 << k, self.ranks[k]
            place = np.arange(0, len(rank), size)
            place = place[place + size <= self.end[place]]
            low = rank[place]
            high = low + np.bincount(rank, minlength=len(rank))[low]
            windows = [(size, 2 * size)] + [(1, size)] * (k == SMALLEST)
            found += [np.stack([place, low, high, place + a, np.minimum(place + b, self.end[place])])[:, high - low > 1] for a, b in windows]
        return np.concatenate(found, axis=1) if found else np.zeros((5, 0), dtype=np.int64)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of pairs to extend."""
        place, low, high, after, until = self.blocks()
        if not len(place):
            return place, place
        wavelet = Wavelet(self.suffixes)
        skipped = wavelet.below(low, high, after)
        many = wavelet.below(low, high, until) - skipped
        some = many > 0
        place, low, high, skipped, many = (x[some] for x in (place, low, high, skipped, many))
        first = wavelet.nth(low, high, skipped)
        more = many > 1
        second = first.copy()
        second[more] = wavelet.nth(low[more], high[more], skipped[more] + 1)
        few, long = many < 3, many >= 3
        own, start, step = place[long], first[long], (second - first)[long]
        ends = start + self.ahead(start, start + step) - own - self.ahead(own, own + step)
        begins = start - self.behind(start, start + step) - own + self.behind(own, own + step)
        places = np.concatenate([place[few], place[few & more], own, own, own])
        periods = np.concatenate([(first - place)[few], (second - place)[few & more], step, ends, begins])
        real = (periods > 0) & (places + periods < self.end[places])
        return tuple(np.unique(np.stack([places[real], periods[real]]), axis=1))

    def runs(self) -> np.ndarray:
        """Rows (start, end, period) in order, each run once with its smallest period."""
        place, period = self.candidates()
        start, end = place - self.behind(place, place + period), place + period + self.ahead(place, place + period)
        real = end - start >= np.maximum(LEAST, TIMES * period)
        found = np.unique(np.stack([start[real], end[real], period[real]], axis=1), axis=0)
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)  # another period of the same stretch is a multiple of its smallest
        found = found[new]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def _found(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """(runs, collapsed text) per document."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.fromiter((number[w] for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    runs, collapsed = [[] for _ in texts], [b" ".join(t) for t in texts]
    if not len(words):
        return runs, collapsed
    ends = np.cumsum(sizes)
    found = Text(words, sizes).runs()
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 1], -1)
    dropped = np.cumsum(edges) > 0
    for (start, end, period), document in zip(found.tolist(), np.searchsorted(ends, found[:, 0], "right").tolist()):
        runs[document].append({"start": start - int(ends[document] - sizes[document]), "length": end - start, "period": period})
    for i, own in enumerate(runs):
        if own:
            gone = dropped[ends[i] - sizes[i] : ends[i]].tolist()
            collapsed[i] = b" ".join([w for w, g in zip(texts[i], gone) if not g])
    return runs, collapsed


def detect(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs array of (start, length, period) by start and period, collapsed text) for every row of ``docs`` (doc_id, text).

    Words are runs of other bytes than blank, tab, newline, vertical tab, form feed and return, numbered from 0.  A run is a
    stretch of at least ``LEAST`` words and ``TIMES`` periods in which words one period apart are equal, the period being the smallest, and which
    no neighbouring word extends.  The collapsed text holds the words that no run contains after its first period, joined
    by blanks.  Null and empty texts have no words, no run and an empty collapsed text.  Rows that repeat a doc_id are
    rows of their own; a null doc_id stays null.  ``change`` may edit the words of a row first.  A document is handled by one task, in memory in proportion to its words.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            held, words = [], 0
            for at in range(batch.num_rows + 1):
                text = None
                if at < batch.num_rows:
                    value = batch.column("text")[at].as_py()
                    text = value.split() if value else []
                    if change is not None:
                        text = change(ids[at], text)
                if held and (text is None or words + len(text) > TOGETHER):
                    runs, collapsed = _found(held)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(at - len(held), len(held)), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"]
                    )
                    held, words = [], 0
                if text is not None:
                    held.append(text)
                    words += len(text)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def most_repeated(runs: str = "runs") -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first; null without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The result of ``detect`` as counts, the most repeated run and SHA-256 of the runs' listing and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", most_repeated()).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
