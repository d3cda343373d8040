"""Index search against a plain scan."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from plurality.operators import index, runlog


def test_search_equals_scan(spark, monkeypatch):
    monkeypatch.setattr(index, "TEXTS_PER_BLOCK", 16)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB é\n😀") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += [None, "", "a", "ab", "common words in many texts", "x" * 50_000 + "needle"] + ["common words in many texts"] * 60
    patterns = ["", "a", "ab", "B a", "é\n", "😀a", "COMMON words", "needle", "xxxx", "not there", "😀", "\n", "abab", "ab", None, "%", "_b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    built = index.build(rows, "id", "text")
    found = index.search(built, spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted((p, i) for p in set(patterns) - {None} for i, t in enumerate(texts) if t is not None and p.lower() in t.lower())
    hot = built.postings.filter("gram = 'com'").select(F.size("offsets").alias("n")).collect()
    assert len(hot) > 4 and sum(r.n for r in hot) == 61
    empty = index.build(rows.limit(0), "id", "text")
    assert index.search(empty, spark.createDataFrame([("a",), ("",)], "pattern string")).count() == 0


def test_configurations_so_far(spark, monkeypatch):
    monkeypatch.setattr(runlog, "STRETCH", 16)
    rng = random.Random(4)
    rows = [(r, s, f"n{s}", rng.choice("abcdefgh") * rng.randint(1, 4), rng.choice([None, 1.0])) for r, many in (("long", 300), ("short", 3)) for s in range(many)]
    log = spark.createDataFrame(rows, "run_id string, seq long, node_id string, config_hash string, val_score double")
    got = {(r.run_id, r.seq): r.k for r in runlog.distinct_so_far(log).collect()}
    seen = {}
    for run, seq, _, config, val in rows:
        own = seen.setdefault(run, set())
        if val is not None:
            own.add(config)
        assert got[run, seq] == len(own)
    means = spark.createDataFrame([("s", 10.0, 100), ("t", 20.0, 50)], "system string, mean double, n long")
    band = runlog.band_progression(log, means, ["s", "t"])
    assert band.count() == 606 and band.filter("low > mean OR high < mean").count() == 0


def _grams_of(texts):
    """Offsets of the padded texts that hold each run of three characters."""
    out = {}
    for at, text in enumerate(texts):
        for i in range(len(text) - 2):
            out.setdefault(text[i : i + 3], set()).add(at)
    return {gram: sorted(held) for gram, held in out.items()}


def test_lists_of_a_block_are_those_of_a_plain_scan():
    rng = random.Random(5)
    some = ["".join(rng.choice("ab é\n\x00😀") for _ in range(rng.randint(0, 40))) + index.PAD for _ in range(30)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]  # so many letters that a gram and a place do not fit one number
    for texts in (some, [index.PAD], ["".join(every[at::20]) + index.PAD for at in range(20)]):
        names, held, offsets = index._held(texts)
        ends = held.cumsum()
        got = {name: offsets[end - n : end].tolist() for name, n, end in zip(names, held.tolist(), ends.tolist())}
        assert len(got) == len(names) and got == _grams_of(texts)


def test_blocks_end_at_few_texts_or_many_characters(spark, monkeypatch):
    monkeypatch.setattr(index, "CHARS_PER_BLOCK", 20_000, raising=False)
    rows = [(i, ("Ab" if i % 2 else "cD") * 2_500 + str(i)) for i in range(80)] + [(200, "Twice"), (200, "Twice"), (201, None)]
    built = index.build(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    per_block = [r["count"] for r in built.places.groupBy("block").count().collect()]
    assert sum(per_block) == 82 and max(per_block) <= 6
    found = index.search(built, spark.createDataFrame([("baba",), ("TWICE",), ("c",)], "pattern string")).collect()
    want = [("baba", i) for i in range(1, 80, 2)] + [("TWICE", 200)] * 2 + [("c", i) for i in [*range(0, 80, 2), 200, 200]]
    assert sorted(map(tuple, found)) == sorted(want)
