from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_documents import brute_lines
from test_shingles import brute_groups

from plurality.llm import toxicity
from plurality.plans.lineage import stored


def test_stages_in_order(spark, sf_dir, monkeypatch):
    """Each stage against a brute-force reading of its own input."""
    monkeypatch.setattr(toxicity, "STEPS", 300)  # of 1,128, for time
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(stored(stage(spark, results[-1], sf_dir), name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    assert all(r.columns == columns for r in results[:-1])
    raw, clean, lined, single, mixed, packed = ([r for r in df.collect()] for df in results)
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in raw} - {r.doc_id for r in clean}
    assert len(gone & toxic) >= 0.5 * len(toxic) and len(gone - toxic) <= 0.1 * len(raw)
    assert {(r[0], r[2]) for r in brute_lines([(r.doc_id, r.text) for r in clean])} == {
        (r.doc_id, r.text.count("\n") + 1 - (after.text.count("\n") + 1 if after.text or r.text == "" else 0))
        for r, after in zip(sorted(clean), sorted(lined)) if after.text
    } | {(r.doc_id, r.text.count("\n") + 1) for r, after in zip(sorted(clean), sorted(lined)) if not after.text}
    groups = brute_groups([r.text for r in lined])
    assert sorted(r.doc_id for r in single) == sorted(min(lined[i].doc_id for i in own) for own in groups)
    counts = Counter(r.doc_id for r in mixed)
    assert set(counts) <= {r.doc_id for r in single} and max(counts.values()) <= 2
    assert Counter(r.doc_id for r in packed if r.piece == 0) == counts


def test_run_and_registration(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(toxicity, "STEPS", 30)
    names = list(entry.queries())
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    assert entry.queries()["pipeline"](spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
