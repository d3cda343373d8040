from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from checking import connect, difference

from plurality.llm import divergence, queries


def brute(rows, least=3, terms=200):
    """The audit of (text, lang, source) rows, straight from the definitions."""
    docs = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, a, s in rows]
    seen, n, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, words in docs:
        seen[lang].update(set(words))
        n[lang, source].update(words)
        n[lang, None].update(words)
    for lang in {a for a, _, _ in docs}:
        kept = [t for t, c in seen[lang].items() if c >= least]

        def share(source):
            total = sum(n[lang, source][t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n[lang, source][t] + 1) // total for t in kept}

        sources = {s for a, s, _ in docs if a == lang}
        for source in sources:
            p, q = share(source), share(None)
            pairs = [(sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o) for o in sources - {source} for r in [share(o)]]
            over = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, source][t] and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < terms]
    return sorted(out)


def audited(spark, rows, **settings):
    full = [(i, t, a, s, 3, 4, 5.0, "x") for i, (t, a, s) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long, value long, p0 double, term string")
    return sorted(tuple(r) for r in divergence.audit(docs, **settings).collect())


def test_query_equals_sql(spark, sf_dir):
    out = queries.op11_divergence_tree(spark, sf_dir)
    assert difference(connect(sf_dir), out, queries.SQL["op11_divergence_tree"]) is None


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, other scripts, a language without kept terms, one of a single source."""
    rows = [
        (None, None, None), ("", "", ""), ("A a Ä ä", None, "x"), ("a1b a", "", None), ("a Ä b c", "", "x"), ("a b", "", "y"), ("a b", "", "y"), ("b " * 60_000, "", "y"),
        ("one", "de", "p"), ("two", "de", "q"), (None, "de", "r"),
        ("solo solo", "fr", "z"), ("solo", "fr", "z"), ("Solo!", "fr", "z"),
    ]
    got = audited(spark, rows)
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "de"} == {0} and not [r for r in got if r[0] == "fr"]


def test_many_sources_and_ties(spark):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(" ".join(rng.choice(words[: 20 + 28 * (i % 11)], rng.integers(0, 60))), "en", f"s{i % 11}") for i in range(400)]
    assert audited(spark, rows, terms=7) == brute(rows, terms=7)


def test_empty_table(spark):
    assert audited(spark, []) == []


@pytest.mark.parametrize("places", [1, 7, 1 << 20])
def test_tree_pieces_add_up(monkeypatch, places):
    """Node-ancestor corrections equal the sum over rows and pairs, wherever the sorted rows are cut."""
    monkeypatch.setattr(divergence, "PLACES", places)
    rng = np.random.default_rng(5)
    rows = Counter()
    for _ in range(300):
        held = [s for s in range(6) if rng.random() < 0.5]
        rows[tuple((f"s{s}", int(rng.integers(2, 6)) * 100, 100 + s) for s in held)] += 1
    lined = sorted(rows)
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())]))
    seen = pa.array([[dict(zip(("source", "p", "p0"), x)) for x in r] for r in lined], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(lined)), seen, pa.array([rows[r] for r in lined], pa.int64())], names=["lang", "seen", "many"])
    got, want = Counter(), Counter()
    for out in divergence._corrections(iter([batch])):
        for r in out.to_pylist():
            got[r["source"], r["item"]] += r["value"]

    def f(p, q):
        return (p - q) ** 2 // q

    for r, many in rows.items():
        for a, p, p0 in r:
            for b, q, q0 in r:
                if a != b:
                    want[a, b] += many * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    assert got == want


def test_shared_paths_are_one_node():
    tree = divergence.Tree(np.array([0, 2, 5]), np.array([2, 3, 1]), np.array([1, 2, 1, 2, 3, 4]), np.array([5, 2, 7]))
    assert tree.many.tolist() == [7, 7, 7, 2] and tree.parent.tolist() == [-1, -1, 0, 2]
