"""Splits, tags, samples, folds and content ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6
from plurality.catalog.ingest import BUCKETS, UNIT
from plurality.functions import keys
from plurality.operators import splits
from plurality.sources import tables

RULES = {"status": "status", "supplier": "Supplier".lower(), "flag": "flag"}
PIN = {"status": "status"}
DOC_RULES = {"license": "license", "released": "released under", "english": " the ", "email": "@"}


def _cells(spark, sf):
    return tables.cells(spark, sf)


def hash_unit(spark, sf):
    fam = _cells(spark, sf).select("dataset", "question").distinct()
    u = keys.hash_unit(0, F.col("dataset"), F.col("question"))
    return fam.select("dataset", "question", F.round(u, 9).alias("u"))


def family_split(spark, sf):
    out = splits.make_split(_cells(spark, sf), rules=PIN, pin_to="test")
    return out.select("record_id", "bucket")


def family_split_by_dataset(spark, sf):
    out = splits.make_split(_cells(spark, sf), {"dev": 0.7, "test": 0.3}, unit="dataset", seed=3, rules=PIN)
    return out.groupBy("dataset", "bucket").agg(F.count(F.lit(1)).alias("n"))


def split_summary(spark, sf):
    return splits.split_summary(splits.make_split(_cells(spark, sf), rules=PIN), rules=PIN)


def leakage_check(spark, sf):
    """Planted leak: supplier families are also written to a second bucket."""
    split = splits.make_split(_cells(spark, sf), rules=PIN).select("dataset", "question", "bucket")
    leak = split.filter(F.col("dataset") == "suppliers").withColumn("bucket", F.lit("holdout"))
    found = splits.leaking_families(split.unionByName(leak)).withColumn("part", F.lit("planted"))
    clean = splits.leaking_families(split).withColumn("part", F.lit("real"))
    return found.unionByName(clean).groupBy("part").agg(F.count(F.lit(1)).alias("families"))


def tag_rules(spark, sf):
    """Every document text against every rule: all hits, and the first hit."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    every = splits.rows_by_rule(docs, "text", DOC_RULES).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    first = docs.groupBy(splits.first_rule(F.col("text"), DOC_RULES).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    any_hit = docs.filter(splits.is_tagged(F.col("text"), DOC_RULES)).agg(F.count(F.lit(1)).alias("n"))
    return (
        every.withColumn("how", F.lit("every"))
        .unionByName(first.withColumn("how", F.lit("first")))
        .unionByName(any_hit.withColumns({"rule": F.lit("any"), "how": F.lit("any")}))
    )


def fingerprint(spark, sf):
    return splits.ordered_fingerprint(_cells(spark, sf))


def content_ids(spark, sf):
    c = F.col
    calibrators = F.array(F.concat(F.lit("temp:"), c("n_grouping_vars").cast("string")))
    message = F.array(F.struct(F.lit("user").alias("role"), c("question").alias("content")))
    return _cells(spark, sf).select(
        "record_id",
        keys.question_id(c("dataset"), c("split"), c("question"), c("segment")).alias("question_id"),
        keys.segment_key(c("segment")).alias("segment_key"),
        keys.config_hash(c("dataset"), c("question"), calibrators).alias("config_hash"),
        keys.request_key(message, F.lit("t=0")).alias("request_key"),
        keys.hash32(F.lit("0"), keys.segment_key(c("segment"))).alias("segment_seed"),
    )


def stratified(spark, sf):
    return splits.stratified_sample(_cells(spark, sf), 200, seed=1).select("dataset", "record_id")


def capped(spark, sf):
    return splits.capped(_cells(spark, sf), 12).select("dataset", "record_id")


def representative(spark, sf):
    return splits.representative(_cells(spark, sf), 25).select("dataset", "record_id")


def folds(spark, sf):
    return splits.folds(_cells(spark, sf)).select("record_id", "fold", "first_half")


def disjoint_fit(spark, sf):
    parts = splits.disjoint_samples(_cells(spark, sf), 150, 300)
    ids = lambda p: parts.filter(F.col("part") == p).select("record_id")
    overlap = ids("eval").intersect(ids("fit")).select(F.lit("overlap").alias("part"), "record_id")
    return parts.select("part", "record_id").unionByName(overlap)


QUERIES = {
    "hash_unit": hash_unit,
    "family_split": family_split,
    "family_split_by_dataset": family_split_by_dataset,
    "split_summary": split_summary,
    "leakage_check": leakage_check,
    "tag_rules": tag_rules,
    "fingerprint": fingerprint,
    "content_ids": content_ids,
    "stratified": stratified,
    "capped": capped,
    "representative": representative,
    "folds": folds,
    "disjoint_fit": disjoint_fit,
}

_TAGS = "(VALUES ('license', 'license', 1), ('released', 'released under', 2), ('english', ' the ', 3), ('email', '@', 4)) r(rule, needle, ord)"
_ORD = "sha256('{seed}::' || record_id)"


def _strat(source: str, n: int, seed: int, name: str) -> str:
    order = _ORD.format(seed=seed)
    return f"""{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {order}) AS rn FROM {source}),
      {name} AS (SELECT dataset, record_id FROM {name}_1 WHERE rn <= greatest(1, {n} // (SELECT count(DISTINCT dataset) FROM {source})) ORDER BY {order} LIMIT {n})"""


SQL = {
    "hash_unit": f"""{VIEWS}, {BUCKETS} SELECT dataset, question, round(u, 9) AS u FROM fam""",
    "family_split": f"{VIEWS}, {BUCKETS} SELECT record_id, bucket FROM cell JOIN bucketed USING (dataset, question)",
    "family_split_by_dataset": f"""{VIEWS}, d AS (SELECT dataset, count(*) AS n, bool_or(contains(lower(question), 'status')) AS pin,
        ('0x' || substr(sha256('3::' || dataset), 1, 16))::UBIGINT / 18446744073709551616.0 AS u FROM cell GROUP BY dataset)
      SELECT dataset, CASE WHEN pin OR u >= 0.7 THEN 'test' ELSE 'dev' END AS bucket, n FROM d""",
    "split_summary": f"""{VIEWS}, {BUCKETS} SELECT bucket, count(DISTINCT dataset || '|' || question) AS families, count(*) AS records,
      CAST(count(*) FILTER (WHERE contains(lower(question), 'status')) AS BIGINT) AS tagged_records FROM cell JOIN bucketed USING (dataset, question) GROUP BY bucket""",
    "leakage_check": f"""{VIEWS} SELECT 'planted' AS part, count(*) AS families FROM (SELECT DISTINCT dataset, question FROM cell WHERE dataset = 'suppliers')""",
    "tag_rules": f"""WITH hits AS (SELECT doc_id, rule, ord FROM documents, {_TAGS} WHERE contains(lower(text), needle))
      SELECT 'every' AS how, rule, count(*) AS n FROM hits GROUP BY ALL
      UNION ALL SELECT 'first', coalesce(rule, ''), count(*) FROM (SELECT d.doc_id, arg_min(rule, ord) AS rule FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id) GROUP BY ALL
      UNION ALL SELECT 'any', 'any', count(DISTINCT doc_id) FROM hits""",
    "fingerprint": f"""{VIEWS}, f AS (SELECT DISTINCT sha256('["' || dataset || '","' || question || '"]') AS h FROM cell),
      b AS (SELECT substr(h, 1, 3) AS pre, sha256(string_agg(h, '' ORDER BY h)) AS b, count(*) AS n FROM f GROUP BY ALL)
      SELECT substr(sha256(string_agg(b, '' ORDER BY pre)), 1, 16) AS fingerprint, CAST(sum(n) AS BIGINT) AS families FROM b""",
    "content_ids": f"""{VIEWS} SELECT record_id,
        substr(sha256('["' || dataset || '","' || split || '","' || question || '"]' || chr(10) || '[' ||
          CASE WHEN split = 'pop' THEN '' ELSE concat_ws(',', '["g1","' || g1 || '"]', '["g2","' || g2 || '"]') END || ']'), 1, 12) AS question_id,
        segkey AS segment_key,
        substr(sha256('{{"calibrators":["temp:' || nv || '"],"model":"' || dataset || '","predictor":"' || question || '"}}'), 1, 16) AS config_hash,
        sha256('[{{"role":"user","content":"' || question || '"}}]' || chr(10) || 't=0') AS request_key,
        CAST(('0x' || substr(sha256('0::' || segkey), 1, 8))::UBIGINT AS BIGINT) AS segment_seed FROM cell""",
    "stratified": f"{VIEWS}, {_strat('cell', 200, 1, 's')} SELECT * FROM s",
    "capped": f"""{VIEWS} SELECT dataset, record_id FROM cell QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY question, segkey) <= 12""",
    "representative": f"""{VIEWS}, o AS (SELECT dataset, question, record_id, {_ORD.format(seed=0)} AS h FROM cell),
      l AS (SELECT *, row_number() OVER (PARTITION BY dataset, question ORDER BY h) AS rq FROM o)
      SELECT dataset, record_id FROM l QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY rq > 1, h) <= 25""",
    "folds": f"""{VIEWS}, o AS (SELECT record_id, row_number() OVER (PARTITION BY dataset ORDER BY {_ORD.format(seed=0)}) AS rn,
        count(*) OVER (PARTITION BY dataset) AS n FROM cell)
      SELECT record_id, CAST((rn - 1) % 2 AS INT) AS fold, rn <= n // 2 AS first_half FROM o""",
    "disjoint_fit": f"""{VIEWS}, {_strat('cell', 150, 0, 'e')}, rest AS (SELECT * FROM cell WHERE record_id NOT IN (SELECT record_id FROM e)), {_strat('rest', 300, 1, 'f')}
      SELECT 'eval' AS part, record_id FROM e UNION ALL SELECT 'fit', record_id FROM f""",
}
