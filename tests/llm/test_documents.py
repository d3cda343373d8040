from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from checking import connect, difference
from pyspark.sql import functions as F

from plurality.llm import lines, mixing, packing, queries, sharding

BLANK = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANK)) for x in (t or "").split("\n")] for _, t in rows]
    found = defaultdict(set)
    for (doc, _), own in zip(rows, keys):
        for key in own:
            if len(key) >= 20:
                found[key].add(doc)
    order = lambda d: (d is not None, d or 0)
    out = []
    for (doc, text), own in zip(rows, keys):
        kept = [x for x, k in zip((text or "").split("\n"), own) if not (len(found.get(k, ())) >= 3 and max(found[k], key=order) != doc)]
        out.append((doc, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_match_sql(spark, sf_dir):
    assert difference(connect(sf_dir), queries.op9_line_dedup(spark, sf_dir), queries.SQL["op9_line_dedup"]) is None


def test_lines_by_brute_force_with_hot_lines(spark, docs_of):
    rng = random.Random(2)
    pool = [f"This is shared line number {i} of some length" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool if rng.random() < 0.7 else [f"own line {i} {rng.random()} and more"]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(i, f"  {pool[0].upper()}\t\nshort\n") for i in range(200, 400)]
    rows += [(7, pool[1]), (7, pool[1] + "\n" + pool[2]), (None, pool[0] + "\n" + pool[3]), (500, None), (501, ""), (502, "\n\n"), (503, "x" * 200_000), (600, "é" * 20), (601, "é" * 20), (602, "é" * 20), (603, "é" * 19), (604, "é" * 19), (605, "é" * 19)]
    docs = docs_of(rows)
    got = sorted((tuple(r) for r in lines.digests(docs, lines.keep_bitmaps(docs)).collect()), key=repr)
    assert got == brute_lines(rows)
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"] == docs.schema["n_chars"]
    digests = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect())
    assert digests == Counter((d, h) for d, _, _, h in got)
    assert lines.without_repeats(docs.limit(0)).count() == 0


def test_bitmaps_say_which_lines_stay(docs_of):
    text = "a line that many documents hold"
    docs = docs_of([(1, f"first\n{text}\nlast"), (2, text), (3, f"{text}\nend")])
    maps = {r.doc_id: np.unpackbits(np.frombuffer(zlib.decompress(r.keep), dtype=np.uint8), count=r.n_lines).tolist() for r in lines.keep_bitmaps(docs).collect()}
    assert maps == {1: [1, 0, 1], 2: [0]}


def test_shards_are_exact_and_repeatable(spark, sf_dir):
    rows = [tuple(r) for r in queries.op6_hypergeometric_shards(spark, sf_dir).collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r[0]: (r[1], r[2]) for r in rows} == {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r[4]].append(r[5])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = queries.op6_hypergeometric_shards(spark, sf_dir)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in again.collect())


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)])
    assert abs(drawn.mean() - 6.0) < 0.05 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.1
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    big = [sharding.hypergeometric(rng, 10**11, 23 * 10**11, 10**8) for _ in range(200)]
    assert abs(np.mean(big) - 10**8 / 24) < 4 * (10**8 / 24) ** 0.5 / 200**0.5 * 1.5
    matrix = sharding.communication_matrix([0, 5, 100, 1, 17], 4, 3)
    assert matrix.sum(axis=1).tolist() == [0, 5, 100, 1, 17] and sorted(matrix.sum(axis=0).tolist()) == [30, 31, 31, 31]


def test_shards_of_odd_rows(docs_of):
    docs = docs_of([(1, "a")] * 30 + [(None, None), (2, ""), (3, "x" * 100_000)])
    out = sharding.shuffle_shards(docs, 4)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(Counter(r.shard for r in out.collect()).values()) == [8, 8, 8, 9]
    assert sharding.shuffle_shards(docs.limit(0), 4).count() == 0
    assert sharding.shuffle_shards(docs.limit(1), 4).count() == 1
    assert [tuple(r) for r in sharding.sized(docs.filter("doc_id IS NULL")).collect()] == [(None, 8, 0)]


def brute_targets(sizes):
    """sizes by source; the excess of stopped sources goes round by weight until none is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    stopped, wanted = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in stopped]
        level = (wanted - sum(stopped.values())) / (sum(weight[s] for s in rest) or 1)
        over = [s for s in rest if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return stopped | {s: level * weight[s] for s in rest}
        stopped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_targets_and_copies(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_pivotal_mix(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in docs.items()}
    sizes = Counter()
    for d, r in docs.items():
        sizes[r.source] += size[d]
    want = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == sizes[source] and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(want[source], rel=1e-9)
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = queries.op3_pivotal_mix(spark, sf_dir)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))


def test_rounding_keeps_expectations(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 40 else "b", 10 + i % 7) for i in range(60)], "doc_id long, source string, size long")
    total = Counter()
    for seed in range(40):
        for r in mixing.copies(sizes, seed=seed).collect():
            total[r.source] += r.copies
            rate = r.target / r.source_size
            assert int(rate) <= r.copies <= int(rate) + (rate % 1 > 0)
    rates = {r.source: r.target / r.source_size for r in mixing.targets(sizes).collect()}
    for source, n in (("a", 40), ("b", 20)):
        assert total[source] / 40 / n == pytest.approx(rates[source], abs=0.03)


def test_mix_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    sizes = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), (F.col("id") % 11).alias("size"))
    got = mixing.copies(sizes)
    assert got.count() == 500
    for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 10


def test_mix_of_odd_rows(docs_of):
    docs = docs_of([(1, "a b c", None), (1, "a b c", None), (None, "x y", "z"), (2, None, "z"), (3, "", "é"), (4, "w " * 50_000, "b")])
    kept = mixing.repeated(docs)
    assert kept.columns == docs.columns and mixing.repeated(docs.limit(0)).count() == 0
    drawn = mixing.copies(docs.select("doc_id", "source", mixing.word_count().alias("size"))).collect()
    assert len(drawn) == 6 and sum(r.copies for r in drawn) == kept.count()
    assert all(r.copies == 0 for r in drawn if r.size == 0)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*out.encode(text or "", add_special_tokens=False).ids, 2]


def check_packed(rows, texts, tokenizer):
    own, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(own) == set(texts)
    for doc, pieces in own.items():
        ids = tokenizer(texts[doc])
        pieces.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(i, s, n) for i, (s, n) in enumerate(packing.cut(len(ids)))]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in pieces]
    for some in places.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in rows)
    return len(places), -(-total // 1024)


def test_packing_query(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, least = check_packed(queries.op7_pattern_packing(spark, sf_dir).collect(), texts, tokenizer)
    assert used <= 1.03 * least + 1


def test_packing_odd_rows(spark, docs_of, tokenizer):
    texts = {1: None, 2: "", 3: "<|endoftext|> it's  two\n\n lines ", 4: "word " * 3000, 5: "日本語 ñ\x85 x"}
    docs = docs_of(list(texts.items()))
    check_packed(packing.pack(docs, queries.vocabulary()).collect(), texts, tokenizer)
    assert packing.pack(docs.limit(0), queries.vocabulary()).count() == 0
    twice = packing.pack(docs_of([(1, "a b")] * 5), queries.vocabulary()).collect()
    assert len(twice) == 5 and len({(r.sequence_id, r.offset) for r in twice}) == 5


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for histogram in ({}, {1024: 3}, {1: 5000}, {600: 10}, {513: 7, 511: 9}, {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 1025, 20_000), return_counts=True))}):
        made = packing.plan(dict(histogram))
        used = Counter()
        for shape, repeats in made:
            assert sum(shape) <= 1024 and repeats > 0
            for n in shape:
                used[n] += repeats
        assert used == Counter(histogram)
    assert sum(r for _, r in made) <= 1.01 * -(-sum(n * c for n, c in histogram.items()) // 1024)
