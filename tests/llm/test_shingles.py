from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from pyspark.sql import functions as F

from plurality.llm import shingles


def brute_set(text):
    words = text.lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_groups(texts):
    """Index groups of texts connected by a similarity of 0.8 or more."""
    sets = [brute_set(t or "") for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                root[top(i)] = top(j)
    out = {}
    for i in range(len(sets)):
        out.setdefault(top(i), []).append(i)
    return list(out.values())


def planted(rng, goal):
    """A text and a copy with words exchanged until their five-word similarity is the last at ``goal`` or more."""
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    copy, best = list(words), list(words)
    a = brute_set(" ".join(words))
    while True:
        copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        b = brute_set(" ".join(copy))
        if len(a & b) / len(a | b) < goal:
            return " ".join(words), " ".join(best)
        best = list(copy)


@pytest.mark.parametrize("goal", [0.8, 0.9, 0.95])
def test_planted_copies_go(spark, docs_of, sf_dir, goal):
    rng = random.Random(int(goal * 100))
    pairs = [planted(rng, goal) for _ in range(60)]
    docs = docs_of([(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)])
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2 * i for i in range(60)]


def test_texts_below_the_bound_stay(docs_of):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for k in range(0, 200, 20):  # ten places, fifty shingles: similarity 0.6
            words[k + 9] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    assert shingles.without_duplicates(docs_of(rows)).count() == 80


def test_crowded_values_meet_their_original(docs_of):
    """Copies near 0.84 to one original are farther than 0.8 from each other, far more than one value may hold."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(200):
        words = list(base)
        for k in rng.sample(range(10, 290, 10), 5):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert [r.doc_id for r in shingles.without_duplicates(docs_of(rows)).collect()] == [0]


def test_sets_and_odd_rows(docs_of):
    for text in ("", " \t", "One", "a b c", "a b c d e f a b c d e", "Ä É x y z w v"):
        assert len(shingles.shingles(text.encode())) == (len(brute_set(text)) if text.split() else 0)
    assert shingles.similarity(np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)) == 0.8
    text = "one two three four five six seven eight nine ten"
    docs = docs_of([(5, text), (5, text), (3, text), (9, None), (8, ""), (7, "  \n"), (None, text), (None, "quite another text"), (1, "z " * 60_000), (1, "z")])
    kept = shingles.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 1, 3, 7]
    assert shingles.without_duplicates(docs.limit(0)).count() == 0


def test_unlike_texts_under_one_id_stay(docs_of):
    a, b, c = ("first text of some words here", "second thing quite unlike the other", "third and last of them all")
    docs = docs_of([(3, a), (3, b), (7, b), (9, c), (3, a), (4, a)])
    assert sorted((r.doc_id, r.text) for r in shingles.without_duplicates(docs).collect()) == [(3, a), (3, b), (9, c)]


def test_components_of_crowds_equal_brute_force(docs_of, monkeypatch):
    """Crowds of hundreds around several originals that share most of their text, so that no hub sees all of them; tiles of a few sets."""
    monkeypatch.setattr(shingles, "TILE", 24)
    monkeypatch.setattr(shingles, "WORDS", 5_000)
    rng = random.Random(8)
    base, texts = [f"w{i}" for i in range(120)], []
    for family in range(5):
        original = list(base)
        for k in range(10, 120, 24):
            original[k] = f"f{family}"
        for i in range(70):
            words = list(original)
            for k in rng.sample(range(5, 115, 10), rng.randint(0, 3)):
                words[k] = f"x{family}-{i}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    want = sorted(min(own) for own in brute_groups(texts))
    assert 1 < len(want) < len(texts)
    assert sorted(r.doc_id for r in shingles.without_duplicates(docs_of(list(enumerate(texts)))).collect()) == want


def test_simhash_gives_candidates_that_are_verified(docs_of, monkeypatch):
    from plurality.llm import simhash

    calls, near = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: calls.append(1) or near(docs))
    words = [f"w{i}" for i in range(400)]
    close, other = " ".join([*words[:-1], "end"]), " ".join(f"o{i}" for i in range(300))
    docs = docs_of([(2, " ".join(words)), (4, close), (6, other), (8, None), (9, ""), (6, close + " more")])
    assert simhash.fingerprint(close.encode()) ^ simhash.fingerprint(" ".join(words).encode()) != 0
    rows = shingles.signatures(docs)
    sets = rows.groupBy("id").agg(F.min(F.struct("doc_id", "mark")).alias("l"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("id", "l.doc_id", "l.mark", "n", "bands")
    grown = shingles.with_simhash(docs, sets)
    assert {len(r.bands) for r in grown.collect()} == {0, shingles.BANDS + 1}
    only = grown.withColumn("bands", F.slice("bands", shingles.BANDS + 1, 1))  # SimHash alone
    ids = {(r.doc_id, r.n): r.id for r in sets.collect()}
    linked = {frozenset((r.a, r.b)) for r in shingles.links(docs, only).collect()}
    pairs = {frozenset(x) for x in ((ids[2, 396], ids[4, 396]), (ids[2, 396], ids[6, 397]), (ids[4, 396], ids[6, 397]))}
    assert linked and linked <= pairs
    calls.clear()
    assert sorted(r.doc_id for r in shingles.without_duplicates(docs).collect()) == [2, 6, 8] and calls


def test_every_row_of_a_set_gives_its_simhash_component(docs_of):
    """Rows of one set of shingles may have far fingerprints: here the second row alone lies in the component of the third."""
    from plurality.llm import simhash

    head, a, b = (["h1", "h2", "h3", "h4"], [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)])
    first, second = " ".join([*head, *a, *head, *b, *head]), " ".join([*(head + a) * 6, *head, *b, *head])
    near = second + " end"
    one, two, three = (simhash.fingerprint(t.encode()) for t in (first, second, near))
    assert set(shingles.shingles(first.encode())) == set(shingles.shingles(second.encode()))
    assert (one ^ two).bit_count() > 4 and (one ^ three).bit_count() > 4 >= (two ^ three).bit_count()
    docs = docs_of([(1, first), (2, second), (3, near), (2, second)])
    rows = shingles.signatures(docs)
    sets = rows.groupBy("id").agg(F.min(F.struct("doc_id", "mark")).alias("l"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("id", "l.doc_id", "l.mark", "n", "bands")
    only = shingles.with_simhash(docs, sets).withColumn("bands", F.slice("bands", shingles.BANDS + 1, 1))  # SimHash alone
    assert only.columns == sets.columns and only.count() == 2
    assert {frozenset((r.a, r.b)) for r in shingles.links(docs, only).collect()} == {frozenset(r.id for r in sets.collect())}
    assert [r.doc_id for r in shingles.without_duplicates(docs).collect()] == [1]


def test_rows_without_an_id_are_compared_with_each_other(docs_of):
    words = [f"w{i}" for i in range(60)]
    text, close, other = " ".join(words), " ".join([*words[:-1], "end"]), "quite another text of some words"
    docs = docs_of([(None, text), (None, close), (None, text), (None, other), (None, None), (None, " "), (4, close), (6, text)])
    kept = shingles.without_duplicates(docs)
    assert kept.schema["doc_id"] == docs.schema["doc_id"] and kept.columns == docs.columns
    rows = [(r.doc_id, (r.text or "").strip()) for r in kept.collect()]
    assert [t for d, t in rows if d is not None] == [close] and (4, close) in rows
    alone = sorted(t for d, t in rows if d is None)
    assert alone in (sorted(["", other, text]), sorted(["", other, close]))
