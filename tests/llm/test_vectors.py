from __future__ import annotations

import numpy as np
import pytest
from checking import connect, difference

from plurality.llm import gridjoin, queries, topk


@pytest.mark.parametrize("name", ["op2_epsilon_grid", "op4_impact_top_k"])
def test_query_matches_sql(spark, sf_dir, name):
    assert difference(connect(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.SQL[name]) is None


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "y") for i, v in rows], "vec_id long, embedding array<float>, node int, vector string")


def brute_links(rows, cosine=0.95):
    ok = [(k, np.array(v, dtype=np.float64)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {k: [] for k in range(len(rows))}
    for k, a in ok:
        for m, b in ok:
            if k != m and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                link[k].append(m)
    seen = {}
    for k in link:
        todo, group = [k], {k}
        while todo:
            for m in link[todo.pop()]:
                if m not in group:
                    group.add(m)
                    todo.append(m)
        seen[k] = min(rows[m][0] for m in group)
    return sorted((rows[k][0], len(link[k]), seen[k]) for k in link)


def test_grid_join_in_many_intervals(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "INTERVAL", 40)
    monkeypatch.setattr(gridjoin, "LEAF", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 10))
    rows = [(i, (centres[i % 12] + rng.normal(size=10) * 0.25).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in gridjoin.near_duplicates(vectors_of(spark, rows)).collect())
    assert got == brute_links(rows)


def test_grid_join_odd_rows(spark):
    rows = [(4, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 0.0]), (8, None), (7, [1.0, None]), (6, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (3, [1.0]), (1, []), (11, [1e-30, 0.0]), (12, [-1.0, 0.0])]
    df = vectors_of(spark, rows)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in gridjoin.near_duplicates(df).collect())
    assert got == brute_links(rows)
    assert gridjoin.near_duplicates(df.limit(0)).count() == 0
    assert gridjoin.near_duplicates(vectors_of(spark, [(8, None)])).first().kept


def test_forest_keeps_connectivity():
    rng = np.random.default_rng(2)
    for share in (0.02, 0.1, 0.5, 1.0):
        linked = rng.random((30, 40)) < share

        def groups(pairs):
            root = list(range(70))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for x, y in pairs:
                root[find(int(x))] = find(30 + int(y))
            return {frozenset(k for k in range(70) if find(k) == find(i)) for i in range(70)}

        x, y = gridjoin.forest(linked)
        assert groups(zip(x, y)) == groups(zip(*np.nonzero(linked)))
        assert all(linked[a, b] for a, b in zip(x, y))


def brute_top(rows, queries_, k=5):
    ok = [(i, np.floor(256.0 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in [x for x in ok if x[0] in queries_]:
        scored = sorted(((int(v @ w), -i) for i, w in ok if i != q), reverse=True)[:k]
        out += [(q, n + 1, -i, s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_over_shards_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(500)]
    rows += [(600 + i, rows[50][1]) for i in range(80)] + [(700, [None] * 16), (750, None), (800, [0.0] * 16)]
    df = vectors_of(spark, rows)
    got = sorted(tuple(r) for r in topk.search(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == brute_top(rows, {i for i, _ in rows if i % 50 == 0})


def test_index_stops_on_proof_only():
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (1000, 12))
    index = topk.Index(rows)
    for query in rng.integers(-200, 200, (50, 12)):
        places = index.search(query, np.zeros(1000, dtype=bool), 5)
        scores = rows @ query
        bar = np.sort(scores)[-5]
        assert set(np.flatnonzero(scores >= bar)) <= set(places)


def test_top_k_odd_rows(spark):
    rows = [(50, [1.0, 1.0]), (1, [1.0]), (2, []), (None, [9.0, 9.0]), (3, [float("nan"), 1.0])]
    df = vectors_of(spark, rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == [(50, 1, 1, 65536), (50, 2, 2, 0)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
