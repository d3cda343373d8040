"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed to rows of an embedding table.  A document is
the mean of its words' vectors.  Table and softmax are fitted together by gradient steps on a bounded sample of labelled
documents.  As the softmax is linear, a word's share of a document's score is one number, the
mean of its subwords' numbers, so scoring needs only one number per table row; unseen spellings get theirs from n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.llm import folds
from plurality.plans.lineage import stored

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
SIZE = 8
#: Steps of the fit, whatever the sample: six passes over a full one.
STEPS = 1128
BATCH = 64
#: Words whose table rows are counted together.
AT_ONCE = 8192
#: Words of sampled documents (a word counts in each document) that a table row must belong to.
LEAST_SEEN = 20
RATE = 0.01
#: Scale of a document's mean vector before the softmax.
GAIN = 100.0
#: Labelled documents of each class that are used at most.
MOST_PER_CLASS = 6000
FOLDS = 5
CACHED_WORDS = 400_000


def subwords(word: str) -> list[int]:
    """Table rows of a word and its character n-grams, the word's ends marked."""
    marked = f"<{word}>"
    parts = dict.fromkeys([marked, *[marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]])
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def words_of(text: str | None) -> tuple[list[str], list[float]]:
    """Different words of a whole text and their shares of it."""
    words: dict[str, int] = {}
    for word in (text or "").lower().split():
        words[word] = words.get(word, 0) + 1
    total = sum(words.values())
    return list(words), [n / total for n in words.values()]


def word_key(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode()) - (1 << 63)


def bags(texts: DataFrame) -> DataFrame:
    """(doc_id, label, words, keys, shares) of sampled documents, made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shares = zip(*map(words_of, batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            columns = [pa.array(words, pa.list_(pa.string())), pa.array([[word_key(w) for w in own] for own in words], pa.list_(pa.int64())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *columns], names=["doc_id", "label", "words", "keys", "shares"])

    return texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, words array<string>, keys array<long>, shares array<float>")


def vocabulary(found: DataFrame) -> DataFrame:
    """(key, rows): every different word of the sample once, with its table rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(list(map(subwords, batch.column("word").to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), rows], names=["key", "rows"])

    each = found.select(F.explode(F.arrays_zip("keys", "words")).alias("at")).select(F.col("at.keys").alias("key"), F.col("at.words").alias("word"))
    return each.groupBy("key").agg(F.min("word").alias("word")).mapInArrow(run, "key long, rows array<int>")


class Lists:
    """Lists of numbers one after another, and the gathering of some of them."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None):
        self.values, self.sizes = values, sizes
        self.starts = np.cumsum(sizes) - sizes if starts is None else starts

    def places(self, some: np.ndarray) -> np.ndarray:
        sizes = self.sizes[some]
        return np.repeat(self.starts[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _summed(of: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of ``values`` per group; a column at a time, so that no large intermediate is made."""
    out = np.empty((groups, values.shape[1]), dtype=np.float32)
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(of, weights=values[:, k], minlength=groups)
    return out


def fit(docs: Lists, shares: np.ndarray, words: Lists, labels: np.ndarray, importance: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """(number per table row, bias): the log odds of label 1 are bias plus the mean over the words of the mean of their rows' numbers.

    ``docs`` lists words per document, ``shares`` says how much of it each is, ``words`` lists table rows per word.  Adam steps on the
    embeddings and the two-class softmax together, always ``STEPS`` batches; ``importance`` restores the classes' shares.  Table rows that
    fewer than ``LEAST_SEEN`` words of documents have stay zero: they would only memorise those.
    """
    rng = np.random.default_rng(seed)
    held = np.bincount(docs.values, minlength=len(words.sizes))  # documents per word
    seen = np.zeros(BUCKETS)
    for at in range(0, len(held), AT_ONCE):
        some = np.arange(at, min(at + AT_ONCE, len(held)))
        seen += np.bincount(words.values[words.places(some)], weights=np.repeat(held[some], words.sizes[some]), minlength=BUCKETS)
    used = np.flatnonzero(seen >= LEAST_SEEN)
    place = np.full(BUCKETS, len(used), dtype=np.int32)  # one more row stands for all that stay zero
    place[used] = np.arange(len(used))
    rows = place[words.values]
    single = np.float32
    start = np.vstack([rng.normal(0, 0.01, (len(used), SIZE)), np.zeros((1, SIZE))])
    values = [start.astype(single), rng.normal(0, 0.1, (SIZE, 2)).astype(single), np.zeros(2, dtype=single)]
    moves = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(labels)):
            order = rng.permutation(len(labels))
        some, order = order[:BATCH], order[BATCH:]
        table, top, bias = values
        pairs = docs.places(some)
        known, word = np.unique(docs.values[pairs], return_inverse=True)
        sizes = words.sizes[known]
        index = rows[words.places(known)]
        vector = np.add.reduceat(table[index], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(single) if len(known) else np.zeros((0, SIZE), dtype=single)
        mean = _summed(np.repeat(np.arange(len(some)), docs.sizes[some]), shares[pairs, None] * vector[word], len(some)) * GAIN
        logits = mean @ top + bias
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(some)), labels[some]] -= 1.0
        error = chance * (importance[some, None] / importance[some].sum())
        back = (error @ top.T * GAIN).astype(single)
        to_word = _summed(word, shares[pairs, None] * np.repeat(back, docs.sizes[some], axis=0), len(known)) / np.maximum(1, sizes[:, None])
        to_table = _summed(index, np.repeat(to_word, sizes, axis=0), len(used) + 1)
        to_table[-1] = 0.0
        for value, grad, (first, second) in zip(values, (to_table, mean.T @ error, error.sum(axis=0)), moves):
            grad = grad.astype(single)
            first *= 0.9
            first += 0.1 * grad
            second *= 0.999
            grad *= grad
            second += 0.001 * grad
            value -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    table, top, bias = values
    numbers = np.zeros(BUCKETS)
    numbers[used] = table[:-1].astype(np.float64) @ (top[:, 1] - top[:, 0]) * GAIN
    return numbers, float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, folds_: int = FOLDS, most: int = MOST_PER_CLASS) -> tuple[np.ndarray, float]:
    """A model from ``labels`` (doc_id, toxic) outside the held-out fold; at most about ``most`` documents of each class.

    A document reaches the driver as pairs (word, share), a word once with its table rows.
    """
    known = folds.one_label(labels, "toxic").filter(folds.remainder(folds_) != 0)
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        own = folds.sample(known.filter(F.col("label") == label), totals.get(label, 0), most)
        picked = own if picked is None else picked.unionByName(own)
    made = stored(bags(folds.sampled_texts(docs, picked)), "bags")
    keys, words = _words(vocabulary(made))
    if not len(keys):
        return np.zeros(BUCKETS), 0.0
    pairs, shares, y = _documents(made, keys)
    pa.default_memory_pool().release_unused()
    share = np.array([totals.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    return fit(pairs, shares, words, y, share[y])


def _words(found: DataFrame) -> tuple[np.ndarray, Lists]:
    """Sorted keys of the words, and their table rows; the driver holds each number once."""
    arrived = found.toArrow()
    keys, values = arrived.column("key").to_numpy(), _flat(arrived.column("rows"))
    sizes = pc.list_value_length(arrived.column("rows")).to_numpy()
    order = np.argsort(keys, kind="stable")
    return keys[order], Lists(values, sizes[order].astype(np.int64), (np.cumsum(sizes, dtype=np.int64) - sizes)[order])


def _documents(made: DataFrame, keys: np.ndarray) -> tuple[Lists, np.ndarray, np.ndarray]:
    """Word numbers, their shares and the label per document, in the order of doc_id: reruns make the same steps."""
    arrived = made.select("doc_id", "label", "keys", "shares").toArrow()
    order = np.lexsort((arrived.column("label").to_numpy(), arrived.column("doc_id").to_numpy()))
    sizes = pc.list_value_length(arrived.column("keys")).to_numpy().astype(np.int64)
    places = [np.searchsorted(keys, c.flatten().to_numpy(zero_copy_only=False)).astype(np.int32) for c in arrived.column("keys").chunks]
    pairs = Lists(np.concatenate(places), sizes[order], (np.cumsum(sizes) - sizes)[order])
    return pairs, _flat(arrived.column("shares")), arrived.column("label").to_numpy().astype(np.int64)[order]


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=column.type.value_type.to_pandas_dtype()), *[c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]])


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from the whole texts."""
    numbers, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(numbers.astype(np.float32))  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value.tolist()  # a word has few rows: plain numbers are faster than array lookups
        known: dict[str, float] = {}

        def number(word: str) -> float:
            value = known.get(word)
            if value is None:
                rows = subwords(word)
                value = sum([values[r] for r in rows]) / len(rows)
                if len(known) < CACHED_WORDS:
                    known[word] = value
            return value

        for batch in batches:
            odds = []
            for text in batch.column("text").to_pylist():
                words = (text or "").lower().split()
                odds.append(bias + (sum(map(number, words)) / len(words) if words else 0.0))
            scores = 1.0 / (1.0 + np.exp(-np.clip(np.array(odds), -50.0, 50.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, folds_: int = FOLDS, most: int = MOST_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Only ``labels`` outside the held-out fold teach; language, source and doc_id are no inputs.  Null and empty texts get
    the bias alone.  Without any label every score is 0.5.  Rows that repeat a doc_id are scored each.  A null
    doc_id has no label and counts as held out.
    """
    out = with_scores(docs.select("doc_id", "text"), train(docs, labels, folds_, most))
    return out.select("doc_id", (folds.remainder(folds_) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, train(docs, labels), name).filter(F.col(name) < 0.5).drop(name)
