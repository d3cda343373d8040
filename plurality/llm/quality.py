"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled good outside the held-out fold; the unlabelled are
documents of the corpus outside that fold, whatever they are.  With the class prior p, estimated as the share of good ones
among labelled documents of the training fold, the risk p * R(positives as 1) + max(0, R(unlabelled as 0) - p *
R(positives as 0)) is unbiased until its second part would turn negative.  A small network over measures
of a text is fitted to it in numpy on bounded samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plurality.llm import folds

FOLDS, HELD_OUT = 3, 1
#: Positives, and unlabelled documents, that are used at most.
MOST = 12_000
HIDDEN = 24
EPOCHS = 30
BATCH = 256
RATE = 0.01
#: Prior where the fold has no labels of both kinds.
USUAL_PRIOR = 0.5

# Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 newline, 5 sentence marks, 6 quotes and brackets, 7 other signs, 8 beyond ASCII, 9 control.
_CLASSES = np.full(256, 9, dtype=np.uint8)
_CLASSES[33:127] = 7
_CLASSES[128:] = 8
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:!?", b"'\"()[]-")):
    _CLASSES[list(_bytes)] = _kind
KINDS = 10


def measures(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text: kinds of characters and of their neighbours, words and lines and how they repeat."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    kinds = _CLASSES[raw]
    size = max(len(raw), 1)
    single = np.bincount(kinds, minlength=KINDS) / size
    double = np.bincount(kinds[:-1].astype(np.int64) * KINDS + kinds[1:], minlength=KINDS * KINDS) / size
    words = (text or "").split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = (text or "").split("\n")
    different = set(words)
    starts, ends = [w[:3] for w in words], [w[-3:] for w in words]
    extra = [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max() / 20.0,
        len(different) / n, len({x.lower() for x in different}) / n, len(set(zip(words, words[1:]))) / n,
        len(set(starts)) / n, len(set(ends)) / n, _top(starts) / n, _top(ends) / n, _top(words) / n,
        len(set(lines)) / len(lines), np.log1p(len(lines)), len(words) / len(lines) / 50.0,
    ]
    return np.concatenate([np.sqrt(single), np.sqrt(double), extra]).astype(np.float32)


def _top(items: list[str]) -> int:
    """How often the most frequent item occurs."""
    counts: dict[str, int] = {}
    for x in items:
        counts[x] = counts.get(x, 0) + 1
    return max(counts.values(), default=0)


class Network:
    """One hidden layer; ``odds`` are the log odds of a good text."""

    def __init__(self, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.moves = [[np.zeros_like(v), np.zeros_like(v)] for v in self.w]
        self.steps = 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8.0, 8.0)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step; ``slope`` is the risk's derivative by each row's odds."""
        z = self.scaled(x)
        hidden = np.tanh(z @ self.w[0] + self.w[1])
        back = np.outer(slope, self.w[2]) * (1 - hidden * hidden)
        grads = [z.T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * self.w[2], np.array([slope.sum()])]
        self.steps += 1
        for value, grad, (first, second) in zip(self.w, grads, self.moves):
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            value -= RATE * (first / (1 - 0.9**self.steps)) / (np.sqrt(second / (1 - 0.999**self.steps)) + 1e-8)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -50.0, 50.0)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1) -> Network:
    """Minimises the non-negative risk with the logistic loss.

    Where a batch's second part is below zero, the step goes up on it instead, which undoes the overfit.
    """
    rng = np.random.default_rng(seed)
    net = Network(positive.shape[1], seed)
    net.mean, net.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    batches = max(1, len(unlabelled) // BATCH)
    for _ in range(EPOCHS):
        for p_rows, u_rows in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)):
            if not len(p_rows):
                p_rows = rng.integers(0, len(positive), 16)
            p, u = positive[p_rows], unlabelled[u_rows]
            p_odds, u_odds = net.odds(p), net.odds(u)
            as_bad_p, as_bad_u = np.logaddexp(0, p_odds).mean(), np.logaddexp(0, u_odds).mean()
            p_up, u_up = _chance(p_odds) / len(p), _chance(u_odds) / len(u)
            if as_bad_u - prior * as_bad_p >= 0:
                net.step(np.concatenate([p, u]), np.concatenate([prior * (p_up - 1.0 / len(p)) - prior * p_up, u_up]))
            else:
                net.step(np.concatenate([p, u]), np.concatenate([prior * p_up, -u_up]))
    return net


def _measured(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([measures(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), made], names=["doc_id", "kind", "measures"])

    return texts.select("doc_id", "kind", "text").mapInArrow(run, "doc_id long, kind int, measures array<float>")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Network | None:
    """A network from good-labelled documents and unlabelled ones, both outside the held-out fold; at most about ``most`` of each."""
    known = folds.one_label(labels, "quality").filter(folds.remainder(FOLDS) != HELD_OUT)
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1):
        return None
    prior = totals[1] / sum(totals.values()) if totals.get(0) else USUAL_PRIOR
    good = folds.sample(known.filter("label = 1"), totals[1], most).select("doc_id", F.lit(1).alias("kind"))
    whole = docs.filter(folds.remainder(FOLDS) != HELD_OUT)
    web = folds.sample(whole, whole.count(), most, seed=2).select("doc_id", "text", F.lit(0).alias("kind"))
    found = _measured(folds.sampled_texts(docs, good).unionByName(web)).toPandas().sort_values(["kind", "doc_id"], kind="stable")
    rows = np.stack(found["measures"].to_numpy()).astype(np.float64) if len(found) else np.zeros((0, 1))
    kind = found["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    return fit(rows[kind == 1], rows[kind == 0], prior)


def with_scores(docs: DataFrame, net: Network | None, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from the whole texts; 0.5 where nothing was learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = _chance(net.odds(np.stack([measures(t) for t in texts]))) if net and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Only ``labels`` outside the held-out fold teach; language, source and doc_id are no inputs.  Null and empty texts are
    measured like any other.  Without a good-labelled document every score is 0.5.  Rows that repeat a doc_id
    are scored each.  A null doc_id has no label and is not held out.
    """
    out = with_scores(docs.select("doc_id", "text"), train(docs, labels, most))
    return out.select("doc_id", (folds.remainder(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
