"""Reading survey text, profiling, exporting, and write-read round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, rounded, scored
from plurality.functions import keys
from plurality.operators import export, profile, splits
from plurality.plans.lineage import scratch, stored
from plurality.sources import records, survey, tables

# Which task kind each demo dataset counts as; anything else is "other".
KINDS = {"events": "risky_choice", "documents": "knowledge", "conversations": "moral_dilemma", "suppliers": "opinion_survey"}


def raw_rows(spark, sf):
    """The cells written back as survey text, in the three spellings found in survey files."""
    cells = tables.cells(spark, sf)
    spelling = keys.hash32(F.col("record_id")) % 3
    pct = F.to_json(F.transform_values("truth", lambda _, p: 100.0 * p))
    literal = F.replace(pct, F.lit('"'), F.lit("'"))
    with_none = F.concat(F.substring(literal, F.lit(1), F.length(literal) - 1), F.lit(", 'refused': None}"))
    answer = F.when(spelling == 0, pct).when(spelling == 1, literal).otherwise(with_none)
    names = F.transform("grouping_keys", lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    keyset = F.when(F.size("grouping_keys") == 0, F.lit("set()")).otherwise(
        F.concat(F.lit("{"), F.array_join(F.reverse(names), ", "), F.lit("}"))
    )
    return cells.select(
        F.col("dataset").alias("dataset_name"),
        F.col("question").alias("input_template"),
        answer.alias("human_answer"),
        F.lit("You answer a survey.").alias("group_prompt_template"),
        F.replace(F.to_json("segment"), F.lit('"'), F.lit("'")).alias("group_prompt_variable_map"),
        keyset.alias("grouping_keys"),
        F.when(spelling == 0, F.col("n_grouping_vars").cast("string")).when(spelling == 1, F.lit("nan")).alias("num_grouping_vars"),
        F.concat("group_size", F.lit(".0")).alias("group_size"),
        "split",
    )


def _long(cells):
    return cells.select(
        F.concat_ws("|", "dataset", "question", keys.segment_key(F.col("segment"))).alias("record_id"),
        "split",
        "n_grouping_vars",
        F.array_join("grouping_keys", ",").alias("grouping_keys"),
        "group_size",
        F.explode("truth").alias("opt", "p"),
    ).withColumn("p", r6("p"))


def ingest_rows(spark, sf):
    return _long(survey.to_cells(raw_rows(spark, sf), F.col("split")))


def ingest_csv(spark, sf):
    """Writes the survey text as CSV files per split and reads them back as cells."""
    path = scratch(spark, "survey")
    raw = raw_rows(spark, sf)
    raw.withColumn("file", F.col("split")).drop("split").write.partitionBy("file").csv(path, header=True, escape='"')
    return _long(survey.read_all(spark, {s: f"{path}/file={s}" for s in ("pop", "grouped")}))


def ingest_split(spark, sf):
    """Questions of several lines, with quotes and separators, read from survey files in blocks of 64 KB."""
    path = scratch(spark, "survey")
    question = F.concat("dataset_name", F.lit("|"), "input_template", F.lit('\nOptions, "as shown":\r\n\n(A): yes'))
    raw_rows(spark, sf).withColumn("input_template", question).write.csv(path, header=True, escape='"')
    with records.block_bytes(spark, 1 << 16):
        raw = stored(records.read(spark, path), "records")
    cells = survey.one_per_record(survey.to_cells(raw, F.col("split")))
    parts = F.split("question", "\n")
    return cells.select(
        F.concat_ws("|", parts[0], keys.segment_key(F.col("segment"))).alias("record_id"),
        "split",
        F.size(parts).alias("n_lines"),
        F.length("question").alias("n_chars"),
        F.size("truth").alias("n_options"),
        "group_size",
    )


def parse_mapping(spark, sf):
    events = tables.table(spark, sf, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("props").alias("text")
    )
    labels = tables.table(spark, sf, "labels").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("nan"))
        .otherwise(F.concat(F.lit("{'quality': "), "quality", F.lit(", 'toxic': None, 3: "), "toxic", F.lit("}")))
        .alias("text"),
    )
    parsed = events.unionByName(labels).select("id", survey.parse_mapping(F.col("text")).alias("m"))
    return parsed.select("id", F.size("m").alias("n"), F.explode_outer("m").alias("label", "value"))


def keyset(spark, sf):
    raw = raw_rows(spark, sf)
    parsed = survey.parse_keyset(F.col("grouping_keys"))
    return raw.groupBy(F.array_join(parsed, ",").alias("variables")).agg(F.count(F.lit(1)).alias("n"))


def normalize_pct(spark, sf):
    """Order counts per customer and status as percentages; customers without a numeric value are dropped."""
    counts = tables.table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("n") == 1, F.lit("once")).otherwise(F.col("n").cast("string"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", text))).alias("m"))
    return maps.select(
        F.col("o_custkey").cast("string").alias("id"), F.explode(survey.normalize_distribution(F.col("m"))).alias("opt", "p")
    ).withColumn("p", r6("p"))


def value_counts(spark, sf):
    return profile.value_counts(tables.personas(spark, sf), ["sex", "marital_status", "education_level", "state"])


def numeric_summary(spark, sf):
    return profile.numeric_summary(tables.table(spark, sf, "orders"), "o_totalprice").withColumnRenamed("column", "name")


def export_rows(spark, sf):
    cells = splits.make_split(tables.cells(spark, sf), rules={"status": "status"}, pin_to="test")
    rows = export.question_export(
        cells, tables.predictions(spark, sf), ours="half", base="marginal", kinds=KINDS, rules={"status": "status"}
    )
    first = lambda c: r6(F.get(F.map_values(F.from_json(c, "map<string,double>")), 0))
    return rows.select(
        "question_id",
        "dataset",
        "task_kind",
        "eval_bucket",
        F.col("split").alias("file"),
        "is_population",
        "num_segment_vars",
        "segment_vars",
        "n_options",
        "group_size",
        "required_question",
        "question_text",
        first("human_dist").alias("human_first"),
        first("our_pred").alias("our_first"),
        *["truth_entropy", "tvd_to_uniform", "normalizer_z", "uniform_score", "our_score", "base_score", "lift"],
    )


def roundtrip_results(spark, sf):
    path = scratch(spark, "results")
    survey.write_results(scored(spark, sf).select("record_id", "system", "split", "score"), path)
    return rounded(survey.read_results(spark, path).select("record_id", F.col("system").cast("string"), "split", "score"), "score")


def roundtrip_topline(spark, sf):
    path = scratch(spark, "topline")
    means = scored(spark, sf).groupBy("system").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean"))
    meta = means.agg(F.count(F.lit(1)).alias("systems"))
    survey.write_topline(means, path, meta)
    return spark.read.schema("system string, n bigint, mean double").csv(path, header=True)


def roundtrip_meta(spark, sf):
    """The settings of every system's run, written as JSON beside its topline and read back together."""
    path = scratch(spark, "meta")
    means = stored(scored(spark, sf).groupBy("system").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean")), "means")
    for system in tables.SYSTEMS:
        own = means.filter(F.col("system") == system)
        survey.write_topline(own, f"{path}/{system}", own.select("system", "n", F.array("mean", F.col("mean") / 2).alias("grid"), F.create_map(F.lit("run"), "system").alias("params")))
    back = survey.read_meta(spark, f"{path}/*", "system string, n bigint, grid array<double>, params map<string,string>")
    return back.select("system", "n", F.col("grid")[0].alias("mean"), F.size("grid").alias("grid_size"), F.col("params")["run"].alias("run"))


def persona_ingest(spark, sf):
    path = scratch(spark, "personas")
    people = tables.personas(spark, sf).withColumn("career_goals_and_ambitions", F.lit(None).cast("string"))
    people.withColumn("not_kept", F.lit(1)).write.parquet(path)
    return survey.ingest_personas(spark, [path], sample=500).select("uuid", "sex", "age", "state")


def _requests(spark, sf):
    return tables.cells(spark, sf).select("record_id", F.sha2("record_id", 256).alias("key"))


def missing_completions(spark, sf):
    requests = _requests(spark, sf)
    stored = requests.filter(keys.hash32(F.col("record_id")) % 7 != 0).select("key", F.lit("text").alias("text"))
    todo = survey.missing_requests(requests, stored).select(F.lit("missing").alias("state"), "record_id")
    done = survey.answered_requests(requests, stored).select(F.lit("stored").alias("state"), "record_id")
    return todo.unionByName(done)


QUERIES = {
    "ingest_rows": ingest_rows,
    "ingest_csv": ingest_csv,
    "ingest_split": ingest_split,
    "parse_mapping": parse_mapping,
    "keyset": keyset,
    "normalize_pct": normalize_pct,
    "value_counts": value_counts,
    "numeric_summary": numeric_summary,
    "export_rows": export_rows,
    "roundtrip_results": roundtrip_results,
    "roundtrip_topline": roundtrip_topline,
    "roundtrip_meta": roundtrip_meta,
    "persona_ingest": persona_ingest,
    "missing_completions": missing_completions,
}

_INGESTED = f"""{VIEWS} SELECT record_id, split, nv AS n_grouping_vars,
  CASE WHEN split = 'pop' THEN '' ELSE concat_ws(',', CASE WHEN g1 IS NOT NULL THEN 'g1' END, CASE WHEN g2 IS NOT NULL THEN 'g2' END) END AS grouping_keys,
  CAST(size AS BIGINT) AS group_size, opt, {R('p')} AS p FROM cl"""

H32 = "('0x' || substr(sha256(record_id), 1, 8))::UBIGINT"
UNIT = "('0x' || substr(sha256('0::' || {k}), 1, 16))::UBIGINT / 18446744073709551616.0"


def _pick(values, index):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} % {len(values)} + 1]"


PERSONAS = f"""personas AS (SELECT 'P' || c_custkey AS uuid, c_custkey AS ck, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
  CAST(15 + (c_custkey * 7) % 70 AS INT) AS age, {_pick(tables.MARITAL, 'c_custkey')} AS marital_status,
  {_pick(tables.EDUCATION, 'c_custkey')} AS education_level, {_pick(tables.STATES, 'c_custkey')} AS state,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS city, {_pick(tables.OCCUPATIONS, 'c_custkey')} AS occupation,
  c_name || ' keeps a balance of ' || CAST(floor(c_acctbal) AS BIGINT) || '.' AS persona,
  CASE WHEN c_custkey % 3 = 0 THEN 'Works with nation ' || c_nationkey END AS professional_persona,
  CASE WHEN c_custkey % 5 = 0 THEN 'Collects stamps' END AS hobbies_and_interests FROM customer)"""

_KIND = "CASE s.dataset " + " ".join(f"WHEN '{d}' THEN '{k}'" for d, k in KINDS.items()) + " ELSE 'other' END"

BUCKETS = f"""fam AS (SELECT *, {UNIT.format(k="dataset || '::' || question")} AS u FROM (SELECT DISTINCT dataset, question FROM cell)),
bucketed AS (SELECT *, CASE WHEN contains(lower(question), 'status') THEN 'test' WHEN u < 0.5 THEN 'dev' WHEN u < 0.75 THEN 'val' ELSE 'test' END AS bucket FROM fam)"""

SQL = {
    "ingest_rows": _INGESTED,
    "ingest_csv": _INGESTED,
    "ingest_split": f"""{VIEWS} SELECT record_id, split, 4 AS n_lines, length(dataset || '|' || question) + 32 AS n_chars,
      CAST(count(*) AS INT) AS n_options, CAST(min(size) AS BIGINT) AS group_size FROM cl GROUP BY record_id, split, dataset, question""",
    "parse_mapping": """
      SELECT 'e' || event_id AS id, 1 AS n, 'k' AS label, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events
      UNION ALL SELECT 'd' || doc_id, 3, 'quality', CAST(quality AS VARCHAR) FROM labels WHERE doc_id % 5 <> 0
      UNION ALL SELECT 'd' || doc_id, 3, 'toxic', NULL FROM labels WHERE doc_id % 5 <> 0
      UNION ALL SELECT 'd' || doc_id, 3, '3', CAST(toxic AS VARCHAR) FROM labels WHERE doc_id % 5 <> 0
      UNION ALL SELECT 'd' || doc_id, 0, NULL, NULL FROM labels WHERE doc_id % 5 = 0""",
    "keyset": f"""{VIEWS} SELECT CASE WHEN split = 'pop' THEN '' ELSE concat_ws(',', CASE WHEN g1 IS NOT NULL THEN 'g1' END,
      CASE WHEN g2 IS NOT NULL THEN 'g2' END) END AS variables, count(*) AS n FROM cell GROUP BY ALL""",
    "normalize_pct": f"""SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderstatus AS opt, {R('n / sum(n) OVER (PARTITION BY o_custkey)')} AS p
      FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) WHERE n > 1""",
    "value_counts": f"""WITH {PERSONAS} SELECT 'sex' AS "column", sex AS value, count(*) AS n FROM personas GROUP BY ALL
      UNION ALL SELECT 'marital_status', marital_status, count(*) FROM personas GROUP BY ALL
      UNION ALL SELECT 'education_level', education_level, count(*) FROM personas GROUP BY ALL
      UNION ALL SELECT 'state', state, count(*) FROM personas GROUP BY ALL""",
    "numeric_summary": """SELECT 'o_totalprice' AS name, min(o_totalprice) AS min, max(o_totalprice) AS max, count(DISTINCT o_totalprice) AS "distinct",
      quantile_cont(o_totalprice, 0.5) AS median FROM orders""",
    "export_rows": f"""{VIEWS}, {BUCKETS}, firsts AS (SELECT record_id, round(p, 6) AS hp FROM cl WHERE pos = 1),
      ours AS (SELECT record_id, round(q, 6) AS oq FROM x WHERE system = 'half' AND pos = 1)
      SELECT substr(sha256('["' || s.dataset || '","' || s.split || '","' || s.question || '"]' || chr(10) || '[' ||
          CASE WHEN s.split = 'pop' THEN '' ELSE concat_ws(',', '["g1","' || g1 || '"]', '["g2","' || g2 || '"]') END || ']'), 1, 12) AS question_id,
        s.dataset, {_KIND} AS task_kind, bucket AS eval_bucket, s.split AS file, s.split = 'pop' AS is_population, nv AS num_segment_vars,
        CASE WHEN s.split = 'pop' THEN '' ELSE concat_ws('|', CASE WHEN g1 IS NOT NULL THEN 'g1' END, CASE WHEN g2 IS NOT NULL THEN 'g2' END) END AS segment_vars,
        k AS n_options, CAST(size AS BIGINT) AS group_size, CASE WHEN s.question = 'status' THEN 'status' ELSE '' END AS required_question,
        s.question AS question_text, {R('hp')} AS human_first, {R('oq')} AS our_first, {R('te')} AS truth_entropy, {R('tvd_u')} AS tvd_to_uniform,
        {R('z')} AS normalizer_z, {R('us')} AS uniform_score, {R('os')} AS our_score, {R('bs')} AS base_score, {R('os - bs')} AS lift
      FROM (SELECT record_id, max(score) FILTER (WHERE system = 'uniform') AS us, max(score) FILTER (WHERE system = 'half') AS os,
          max(score) FILTER (WHERE system = 'marginal') AS bs FROM scored GROUP BY record_id) w
      JOIN (SELECT * FROM scored WHERE system = 'uniform') s ON s.record_id = w.record_id
      JOIN bucketed b ON b.dataset = s.dataset AND b.question = s.question
      JOIN firsts f ON f.record_id = w.record_id JOIN ours o ON o.record_id = w.record_id""",
    "roundtrip_results": f"{VIEWS} SELECT record_id, system, split, {R('score')} AS score FROM scored",
    "roundtrip_topline": f"{VIEWS} SELECT system, count(*) AS n, {R('avg(score)')} AS mean FROM scored GROUP BY system",
    "roundtrip_meta": f"{VIEWS} SELECT system, count(*) AS n, {R('avg(score)')} AS mean, 2 AS grid_size, system AS run FROM scored GROUP BY system",
    "persona_ingest": f"WITH {PERSONAS} SELECT uuid, sex, age, state FROM personas ORDER BY sha256('0::' || uuid) LIMIT 500",
    "missing_completions": f"""{VIEWS} SELECT CASE WHEN {H32} % 7 = 0 THEN 'missing' ELSE 'stored' END AS state, record_id FROM cell""",
}
