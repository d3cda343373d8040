from __future__ import annotations

import math
import zlib

from pyspark.sql import functions as F

from plurality.llm import queries, quality, toxicity, urls

SF = "/root/testdata/sf0.1"


def held_out_accuracy(rows, truth, of, rest):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == rest) for r in rows)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in rows)
    known = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(p == y for p, y in known) / len(known)


def labels_of(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_toxicity_on_held_out_documents(spark):
    rows = queries.op5_subword_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert held_out_accuracy(rows, labels_of(spark, "toxic"), 5, 0) >= 0.9


def test_quality_on_held_out_documents(spark):
    rows = queries.op8_pu_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert held_out_accuracy(rows, labels_of(spark, "quality"), 3, 1) >= 0.98


def test_unseen_spellings_share_subwords(spark, docs_of):
    docs = docs_of([(i, f"calm words about rivers and hills {i} " + ("you are such an abominable creature" if i % 2 else "you are such a lovely creature")) for i in range(200)] + [(1000, "you are such an abominablle creature"), (1001, "you are such a lovelly creature")])
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert score[1000] > 0.5 > score[1001]
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} >= {i for i in range(0, 200, 2)}


def test_labels_of_the_held_out_fold_teach_nothing(spark, docs_of):
    docs = docs_of([(i, f"text {i} " + ("bad " if i % 2 else "good ") * 5) for i in range(60)])
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    base = [(i, i % 2) for i in range(60)]
    flipped = [(i, 1 - y if i in held else y) for i, y in base]
    a, b = (sorted(map(tuple, toxicity.scored(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (base, flipped))
    assert a == b
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    flipped = [(i, 1 - y if i in held else y) for i, y in base]
    a, b = (sorted(map(tuple, quality.scored(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (base, flipped))
    assert a == b


def test_classifiers_with_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "x" * 200_000), (None, "some text"), (4, "word"), (4, "word")])
    for make, name in ((toxicity.scored, "toxic"), (quality.scored, "quality")):
        for labels in ([], [(4, 1), (4, 0), (None, 1), (9, None)], [(2, 0), (4, 0)]):
            rows = make(docs, spark.createDataFrame(labels, f"doc_id long, {name} int")).collect()
            assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert make(docs.limit(0), spark.createDataFrame([], f"doc_id long, {name} int")).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_rules_by_brute_force(spark, sf_dir):
    odd = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y=1#z", "http://xexample.com/en/", "http://a.net/es", "http://a.net/es/", "http://NET/fr/?q", "http://a.net?x=/es/", "x://y://z.com/", "http://exämple.com/ü", "http://a.com/\nb", "http://" + "a" * 5000 + ".com/" + "b/" * 5000]
    extra = spark.createDataFrame([(10**6 + i, u, "", 1) for i, u in enumerate(odd)], "page_id long, url string, html string, host int")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", F.lit(1)).unionByName(extra)
    given = {r.page_id: r.url for r in pages.collect()}
    rows = urls.judged(pages).collect()
    assert sorted(r.page_id for r in rows) == sorted(given)
    for r in rows:
        host, path, rule, verdict = brute_rule(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert r.verdict == verdict if rule else r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_trees_learn_lexical_differences(spark):
    good = [(i, f"http://site{i % 7}.org/a/{'abcdefgh'[i % 8]}/page") for i in range(300)]
    bad = [(1000 + i, f"http://host{i % 5}.org/{i * 7919 % 100000}{i * 104729 % 1000000}?a={i}&b={i * 3}&c=1") for i in range(300)]
    rules = [(f"site{k}.org", "/a/", "allow") for k in range(5)] + [(f"host{k}.org", "/", "block") for k in range(3)]
    rows = urls.judged(spark.createDataFrame(good + bad, "page_id long, url string"), rules).collect()
    judged = [r for r in rows if r.rule is None]
    assert len(judged) > 100 and all((r.verdict == "block") == (r.page_id >= 1000) for r in judged)


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("abcd",), ("a.a.",)], "t string").select(urls._entropy(F.col("t")).alias("e")).collect()
    assert [round(r.e, 9) for r in got] == [1.0, 0.0, 2.0, 1.0] and math.isfinite(got[1].e)


def test_filter_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judged(pages).collect()] == ["allow"] * 3
    assert urls.judged(pages.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, sf_dir):
    for name in ("op3_pivotal_mix", "op10_url_filter"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
