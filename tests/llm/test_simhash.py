from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plurality.llm import graph, queries, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint); smallest doc_id reachable over at most four differing bits."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = np.array([f for _, f in rows], dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            root[find(i)] = find(int(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(rows))]


def test_fingerprint_by_definition():
    for text in (None, "", " \t\n", "One", "a b c", "A b C d", "x " * 50, "Ä É ß STRASSE", "a\x0bb\x0cc\rd\x1ce f", "w " * 100_000, "ünï cödé \x85 x"):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_multi_index(spark, sf_dir).collect()}
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps))}


def _connected(spark, values, crowd):
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), crowd=crowd)
    return {r.node: r.root for r in graph.components(edges).collect()}


def test_links_connect_like_all_pairs(spark):
    rng = random.Random(3)
    values = {0}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(8):
            values.add(centre)
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])))
    values = sorted(values)
    want = brute_components(list(zip(range(len(values)), values)))
    for crowd in (64, 1):  # tables only; nearly all by whole balls
        roots = _connected(spark, values, crowd)
        names = [roots.get(int(np.uint64(v).astype(np.int64)), ("alone", v)) for v in values]
        assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def test_no_exploded_side_is_broadcast(spark):
    """Spark sizes the values asked for like the fingerprints they are exploded from, so it would send them through the driver."""

    def nodes(plan):
        children = plan.children()
        return [plan, *(n for i in range(children.size()) for n in nodes(children.apply(i)))]

    fps = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    near = simhash.links(fps)
    found = nodes(near._jdf.queryExecution().sparkPlan())
    joins = [n for n in found if n.nodeName() == "BroadcastHashJoin"]
    built = [n.left() if n.buildSide().toString() == "BuildLeft" else n.right() for n in joins]
    assert any(n.nodeName() == "Generate" for n in found)
    assert not any(n.nodeName() == "Generate" for side in built for n in nodes(side))


def test_segments_leave_no_pair_out():
    rng = random.Random(1)
    for parts in (2, 3, 4):
        layout = simhash.segments(parts, 4)
        for _ in range(2000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            assert any((diff >> s & ((1 << w) - 1)).bit_count() <= r for s, w, r in layout)


def test_odd_rows(docs_of):
    text = "one two three four five six seven eight nine ten"
    docs = docs_of([(5, text), (5, text), (3, text), (9, None), (8, ""), (7, "  \n"), (None, text), (None, "quite another text of some words here"), (1, "z " * 60_000)])
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 3), (1, 1), (3, 3), (5, 3), (5, 3), (7, 7), (8, 7), (9, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1500)] + [(7, 7)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {roots[i] for i in range(301)} == {0} and {roots[i] for i in range(1000, 1500)} == {1000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
