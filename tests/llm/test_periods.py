from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from plurality.llm import periods, queries


def brute_runs(words):
    """(start, length, period) of every maximal stretch, period by period; a stretch found before has a smaller period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text, plant=True):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = s, length, q, 1000 * length // q
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def mixed(rng):
    """Words in which repetitions of many periods meet, touch and overlap."""
    out, k, n = [], rng.randint(1, 5), rng.randint(0, 260)
    while len(out) < n:
        if rng.random() < 0.6:
            root = [rng.randint(0, k) for _ in range(rng.randint(1, rng.choice([3, 9, 20, 40])))]
            out += (root * rng.randint(1, 12))[: rng.randint(1, 200)]
        else:
            out += [rng.randint(0, 3 * k) for _ in range(rng.randint(0, 6))]
    return [b"%d" % x for x in out[:n]]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [mixed(rng) for _ in range(rng.randint(1, 12))]
        runs, _ = periods._found(texts)
        assert [[tuple(r.values()) for r in own] for own in runs] == [brute_runs(t) for t in texts]


def test_progressions_of_short_periods():
    """Blocks that are periodic themselves inside runs of long periods, cut so that only one end of a stretch lies inside."""
    for short, many, tail, cut in [(1, 20, 5, 3), (2, 16, 3, 1), (3, 9, 1, 2), (1, 40, 1, 39), (5, 7, 2, 30)]:
        root = [i % short for i in range(short * many)] + [9 + i for i in range(tail)]
        for shift in range(0, len(root), 3):
            words = [b"%d" % x for x in (root[shift:] + root * 4)[: 3 * len(root) + cut]]
            assert [tuple(r.values()) for r in periods._found([words])[0][0]] == brute_runs(words)


def test_wavelet_successors():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    tree = periods.Wavelet(values)
    low = rng.integers(0, 300, 500)
    high = low + rng.integers(1, 301 - low)
    bound = rng.integers(0, 301, 500)
    below = tree.below(low, high, bound)
    assert below.tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
    some = below < high - low
    got = tree.nth(low[some], high[some], below[some])
    assert got.tolist() == [int(min(v for v in values[a:b] if v >= x)) for a, b, x in zip(low[some], high[some], bound[some])]


def test_suffix_array():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 40, 1, 0, 70, 25])
    words = rng.integers(0, 2, sizes.sum())
    text = periods.Text(words, sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    assert text.suffixes.tolist() == sorted(range(len(words)), key=lambda i: (document[i], words[i : ends[i]].tolist()))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    small = [r for r in docs if len((r.text or "").split()) <= 1500]
    assert len(small) > 0.8 * len(docs)
    out = queries.op13_periodic_runs(spark, sf_dir)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert len(got) == len(docs)
    assert [got[r.doc_id] for r in small] == [brute_digest(r.doc_id, r.text) for r in small]
    assert sum(r[1] > 0 for r in got.values()) > 0.02 * len(docs)


def test_odd_rows(docs_of):
    """Nulls, empty and very long texts, one word over and over, repeated and missing ids, blanks of all kinds."""
    long = " ".join(str(i % 7) if i < 30_000 else str(i) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "w " * 23), (5, "w\x0b" * 24), (5, "w " * 40 + "end"), (None, "a b\r\nA " * 9), (None, None), (6, long), (7, "  é " * 30), (8, "x y z " * 8 + "x")]
    docs = docs_of(rows)
    out = periods.digests(periods.detect(docs)).collect()
    expected = [brute_digest(d, t, plant=False) for d, t in rows if t is not long]
    assert sorted(map(repr, (tuple(r) for r in out if r.doc_id != 6))) == sorted(map(repr, expected))
    big = [r for r in out if r.doc_id == 6]
    assert [(r.n_runs, r.start, r.length, r.period) for r in big] == [(1, 0, 30_000, 7)]
    kept = " ".join(x for i, x in enumerate(long.split()) if i < 7 or i >= 30_000)
    assert big[0].collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert periods.detect(docs.limit(0)).count() == 0


def test_spans_and_text(docs_of):
    docs = docs_of([(1, "start " + "a b c " * 10 + "stop")])
    row = periods.detect(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 30, 3)] and row.collapsed == "start a b c stop"
