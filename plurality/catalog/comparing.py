"""Paired comparisons, ceilings, selectors, and browsing of the export."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, replicates, rounded, scored
from plurality.catalog.calibration import labelled
from plurality.catalog.errors import DEC
from plurality.catalog.ingest import BUCKETS, KINDS
from plurality.operators import compare, evaluate, explore, export, index, specs, splits
from plurality.operators.decompose import decompose
from plurality.operators.export import kind_of
from plurality.plans.lineage import stored
from plurality.sources import tables

B = 2000
_WORDS = {"supplier": "s_suppkey", "documents": "lang", "events": "event_type", "customer": "c_mktsegment"}
_PASSAGES = {"benchmark": "text", "nation": "n_name", "region": "r_name"}
ROUTES = {"opinion_survey": "task_context", "knowledge": "task_context", "risky_choice": "abstain", "moral_dilemma": "abstain"}


def _paired(spark, sf, a="marginal", b="half"):
    return evaluate.paired_scores(scored(spark, sf), a, b)


def _wide(spark, sf):
    return stored(evaluate.wide_scores(scored(spark, sf), tables.SYSTEMS), "wide")


def paired_delta(spark, sf):
    return rounded(compare.blocks(_paired(spark, sf), n_boot=B), "first", "second", "delta", "d_lo", "d_hi")


def confirmation(spark, sf):
    return compare.confirmation(compare.blocks(_paired(spark, sf), n_boot=B))


def noise_floor(spark, sf):
    stats = evaluate.split_stats(scored(spark, sf), n_boot=B)
    return rounded(compare.noise_floor(stats, "blend"), "gap", "floor")


def score_corr(spark, sf):
    return rounded(compare.score_correlation(_paired(spark, sf)), "corr")


def per_kind(spark, sf):
    out = compare.by_kind(_paired(spark, sf), kind_of(F.col("dataset"), KINDS), ROUTES, "base")
    return rounded(out, "first", "second", "delta")


def mechanism(spark, sf):
    out = compare.mechanism(decompose(scored(spark, sf)), "marginal", "half")
    return rounded(out, "marginal", "half")


def oracle_ceiling(spark, sf):
    return rounded(compare.oracle_ceiling(_wide(spark, sf), "half"), "model", "abstain", "oracle", "captured")


def dataset_oracle(spark, sf):
    out = compare.dataset_oracle(_wide(spark, sf), "marginal", "half", "peaked")
    return rounded(out, "base", "routed", "floor", "oracle")


def two_fold_select(spark, sf):
    out = compare.two_fold_select(_wide(spark, sf), "marginal", "half", n_boot=B)
    return rounded(out, "first", "second", "selected", "gain", "g_lo", "g_hi")


def fold_choices(spark, sf):
    return compare.fold_choices(_wide(spark, sf), "marginal", "half")


def complete_cases(spark, sf):
    """Pairs where both systems answered: unreadable responses have no prediction and drop out."""
    from plurality.operators import draws

    cells = tables.cells(spark, sf)
    parsed = draws.parse_predictions(tables.completions(spark, sf), cells)
    preds = parsed.select("record_id", "system", F.when(~F.col("parse_failed"), F.col("pred")).alias("pred"))
    rows = evaluate.paired_scores(evaluate.evaluate(cells, preds.filter(F.col("pred").isNotNull())), "half", "blend")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("first"), F.avg("score_b").alias("second"))
    return rounded(out, "first", "second")


def _export(spark, sf):
    cells = splits.make_split(tables.cells(spark, sf), rules={"status": "status"}, pin_to="test")
    return export.question_export(cells, tables.predictions(spark, sf), "half", "marginal", KINDS, {"status": "status"})


def explorer_filter(spark, sf):
    """Running means of several filters."""
    rows = _export(spark, sf)
    views = {
        "all": {},
        "kind": {"kind": "opinion_survey"},
        "dataset": {"dataset": "ASIA"},
        "bucket": {"bucket": "val"},
        "required": {"required_only": True},
        "search": {"search": " Returned "},
        "both": {"kind": "opinion_survey", "bucket": "dev", "search": "supplier 1"},
    }
    return rounded(explore.summaries(rows, views), "ours", "base", "lift")


def explorer_page(spark, sf):
    """First page of one filter in each of the six orders."""
    rows = explore.filter_export(_export(spark, sf), kind="opinion_survey")
    rows = stored(rows.select("question_id", "our_score", "lift", "truth_entropy"), "page")
    out = None
    for order in explore.ORDERS:
        page = explore.ordered(rows, order).limit(20).select(F.lit(order).alias("page"), "question_id")
        out = page if out is None else out.unionByName(page)
    return out


def explorer_search(spark, sf):
    """What a search for each supplier number, language, event type and segment finds in the export: rows and running means."""
    rows = stored(_export(spark, sf).select("question_text", "our_score", "base_score"), "export")
    words = None
    for name, word in _WORDS.items():
        part = tables.table(spark, sf, name).select(F.col(word).cast("string").alias("pattern")).distinct()
        words = part if words is None else words.unionByName(part)
    found = index.search(index.build(rows.select("question_text").distinct(), "question_text", "question_text"), words)
    hits = found.join(rows, F.col("id") == F.col("question_text"))
    out = hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.avg("our_score").alias("ours"), F.avg("base_score").alias("base"))
    return rounded(out, "ours", "base")


def passage_search(spark, sf):
    """Documents that hold a benchmark passage word for word, ignoring case, or name a nation or a region."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    words = None
    for name, word in _PASSAGES.items():
        part = tables.table(spark, sf, name).select(F.col(word).alias("pattern"))
        words = part if words is None else words.unionByName(part)
    return index.search(index.build(docs, "doc_id", "text"), words).select(F.md5("pattern").alias("pattern"), F.col("id").alias("doc_id"))


def keyword_rows(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    return explore.keyword_rows(docs, "text", ["license", "released"], ["doc_id"], 6).select("doc_id")


def distinct_families(spark, sf):
    return tables.cells(spark, sf).select("dataset", "question").distinct()


def union_systems(spark, sf):
    preds = tables.predictions(spark, sf)
    parts = [preds.filter(F.col("system") == s) for s in ("half", "peaked")]
    both = evaluate.union_systems(*parts)
    return both.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


SPECS = (
    specs.Spec("model_a", "half"),
    specs.Spec("model_a", "half").with_calibrator("temp", temperature=2.0),
    specs.Spec("model_a", "peaked").with_calibrator("dirichlet", alpha=0.1),
)


def spec_scores(spark, sf):
    """Several pipeline descriptions scored in one pass, keyed by their content hash."""
    from plurality.operators.calibrate import row_score

    rows = specs.run_specs(labelled(spark, sf), SPECS)
    means = rows.groupBy("config_hash").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(row_score(F.col("v")))).alias("score"))
    return specs.spec_table(spark, SPECS).select("config_hash", "model", "predictor").join(means, "config_hash")


QUERIES = {
    "paired_delta": paired_delta,
    "confirmation": confirmation,
    "noise_floor": noise_floor,
    "score_corr": score_corr,
    "per_kind": per_kind,
    "mechanism": mechanism,
    "oracle_ceiling": oracle_ceiling,
    "dataset_oracle": dataset_oracle,
    "two_fold_select": two_fold_select,
    "fold_choices": fold_choices,
    "complete_cases": complete_cases,
    "explorer_filter": explorer_filter,
    "explorer_page": explorer_page,
    "explorer_search": explorer_search,
    "passage_search": passage_search,
    "keyword_rows": keyword_rows,
    "distinct_families": distinct_families,
    "union_systems": union_systems,
    "spec_scores": spec_scores,
}

_KIND = "CASE dataset " + " ".join(f"WHEN '{d}' THEN '{k}'" for d, k in KINDS.items()) + " ELSE 'other' END"
_ROUTE = "CASE kind " + " ".join(f"WHEN '{d}' THEN '{k}'" for d, k in ROUTES.items()) + " ELSE 'base' END"
WIDE = f"""{VIEWS}, wide AS (SELECT record_id, dataset, split, question, max(score) FILTER (WHERE system = 'uniform') AS uniform,
  max(score) FILTER (WHERE system = 'marginal') AS marginal, max(score) FILTER (WHERE system = 'half') AS half,
  max(score) FILTER (WHERE system = 'peaked') AS peaked FROM scored GROUP BY ALL)"""
_FOLDS = """fo AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sha256('0::' || record_id)) AS rn, count(*) OVER (PARTITION BY dataset) AS dn FROM wide),
  ff AS (SELECT *, CAST((rn - 1) % 2 AS INT) AS fold, rn <= dn // 2 AS fh FROM fo)"""
_BLOCKS = f"""{WIDE}, bl AS (SELECT record_id, unnest(['overall', split]) AS block, marginal AS s1, half AS s2, half - marginal AS delta FROM wide),
  {replicates('bl', 'block', 'delta', B)},
  bt AS (SELECT block, count(*) AS n, avg(s1) AS first, avg(s2) AS second, avg(delta) AS delta FROM bl GROUP BY block),
  bc AS (SELECT block, quantile_cont(mean, 0.025) AS d_lo, quantile_cont(mean, 0.975) AS d_hi FROM boot GROUP BY block)"""
_EXPORT = f"""{WIDE}, {BUCKETS}, ex AS (SELECT w.record_id, w.dataset, w.question, {_KIND.replace('dataset', 'w.dataset', 1)} AS kind, bucket, {R('half')} AS os, {R('marginal')} AS bs,
    {R('half - marginal')} AS lift, {R('te')} AS te, substr(sha256('["' || w.dataset || '","' || w.split || '","' || w.question || '"]' || chr(10) || '[' ||
      CASE WHEN w.split = 'pop' THEN '' ELSE concat_ws(',', '["g1","' || g1 || '"]', '["g2","' || g2 || '"]') END || ']'), 1, 12) AS question_id
  FROM wide w JOIN bucketed b ON b.dataset = w.dataset AND b.question = w.question JOIN truth t ON t.record_id = w.record_id)"""
_PAGES = {
    "ours_desc": "os DESC", "ours_asc": "os", "lift_desc": "lift DESC", "lift_asc": "lift", "entropy_desc": "te DESC", "entropy_asc": "te",
}
_VIEW = "SELECT '{n}' AS view, count(*) AS n, " + R("avg(os)") + " AS ours, " + R("avg(bs)") + " AS base, " + R("avg(os) - avg(bs)") + " AS lift FROM ex WHERE {w}"
_VIEW_FILTERS = {
    "all": "true",
    "kind": "kind = 'opinion_survey'",
    "dataset": "dataset = 'ASIA'",
    "bucket": "bucket = 'val'",
    "required": "question = 'status'",
    "search": "contains(lower(question), 'returned')",
    "both": "kind = 'opinion_survey' AND bucket = 'dev' AND contains(lower(question), 'supplier 1')",
}
_H = "('0x' || substr(sha256(record_id || '::' || system), 1, 8))::UBIGINT"


def _spec_hash(calibrators: str, predictor: str) -> str:
    text = '{"calibrators":' + calibrators + ',"model":"model_a","predictor":"' + predictor + '"}'
    return f"substr(sha256('{text}'), 1, 16)"


_ROWSCORE = "avg(CASE WHEN tvd_u <= 0 THEN 0 ELSE 100 * (1 - tvd / tvd_u) END)"

SQL = {
    "paired_delta": f"""{_BLOCKS} SELECT block, n, {R('first')} AS first, {R('second')} AS second, {R('delta')} AS delta, {R('d_lo')} AS d_lo, {R('d_hi')} AS d_hi FROM bt JOIN bc USING (block)""",
    "confirmation": f"""{_BLOCKS}, r AS (SELECT bool_or(block = 'overall' AND d_lo > 0) AS pooled_gain, bool_or(block = 'grouped' AND d_hi >= 0) AS grouped_safe,
      bool_or(block = 'pop' AND d_hi >= 0) AS pop_safe FROM bc) SELECT *, pooled_gain AND grouped_safe AND pop_safe AS confirmed FROM r""",
    "noise_floor": f"""{VIEWS}, g AS (SELECT * FROM scored WHERE split = 'grouped'), {replicates('g', 'system', 'score', B)},
      s AS (SELECT system, avg(score) AS gm, (SELECT (quantile_cont(mean, 0.975) - quantile_cont(mean, 0.025)) / 2 FROM boot WHERE boot.system = g.system) AS hw FROM g GROUP BY system),
      d AS (SELECT s.system, s.gm - b.gm AS gap, greatest(s.hw, b.hw) AS floor FROM s, (SELECT * FROM s WHERE system = 'blend') b WHERE s.system <> 'blend')
      SELECT system, {R('gap')} AS gap, {R('floor')} AS floor, CASE WHEN gap > floor THEN 'beats' WHEN gap > -floor THEN 'ties' ELSE 'loses' END AS verdict FROM d""",
    "score_corr": f"{WIDE} SELECT count(*) AS n, {R('corr(marginal, half)')} AS corr FROM wide",
    "per_kind": f"""{WIDE}, k AS (SELECT *, {_KIND} AS kind FROM wide) SELECT kind, count(*) AS n, {R('avg(marginal)')} AS first, {R('avg(half)')} AS second,
      {R('avg(half - marginal)')} AS delta, {_ROUTE} AS route FROM k GROUP BY kind""",
    "mechanism": f"""{DEC}, f AS (SELECT system, unnest(['pred_entropy', 'truth_entropy', 'concentration_err', 'location_err', 'mode_mass_err', 'abs_entropy_gap', 'mode_match_rate']) AS facet,
        unnest([pe, te, conc, loc, mme, abs(gap), mm::INT::DOUBLE]) AS v FROM dec)
      SELECT facet, {R("avg(v) FILTER (WHERE system = 'marginal')")} AS marginal, {R("avg(v) FILTER (WHERE system = 'half')")} AS half FROM f GROUP BY facet""",
    "oracle_ceiling": f"""{WIDE}, {_FOLDS}, fl AS (SELECT dataset, avg(half) < 0 AS ab FROM ff WHERE fh GROUP BY dataset),
      r AS (SELECT count(*) AS n, avg(half) AS m, avg(CASE WHEN ab THEN uniform ELSE half END) AS a, avg(greatest(half, uniform)) AS o FROM ff LEFT JOIN fl USING (dataset) WHERE NOT fh)
      SELECT n, {R('m')} AS model, {R('a')} AS abstain, {R('o')} AS oracle, {R('CASE WHEN o > m THEN (a - m) / (o - m) END')} AS captured FROM r""",
    "dataset_oracle": f"""{WIDE}, d AS (SELECT dataset, avg(marginal) AS m, avg(half) AS h, avg(peaked) AS p, avg(uniform) AS u FROM wide GROUP BY dataset),
      r AS (SELECT unnest(['overall', split]) AS block, marginal, peaked, CASE WHEN p < u THEN uniform ELSE peaked END AS fl, CASE WHEN h > m THEN half ELSE marginal END AS o FROM wide JOIN d USING (dataset))
      SELECT block, count(*) AS n, {R('avg(marginal)')} AS base, {R('avg(peaked)')} AS routed, {R('avg(fl)')} AS floor, {R('avg(o)')} AS oracle FROM r GROUP BY block""",
    "two_fold_select": f"""{WIDE}, {_FOLDS}, ch AS (SELECT dataset, 1 - fold AS fold, avg(half) > avg(marginal) AS us FROM ff GROUP BY dataset, fold),
      pk AS (SELECT record_id, marginal, half, CASE WHEN coalesce(us, false) THEN half ELSE marginal END AS c, CASE WHEN coalesce(us, false) THEN half - marginal ELSE 0 END AS gain
        FROM ff LEFT JOIN ch USING (dataset, fold)), {replicates('pk', '', 'gain', B)}
      SELECT n, {R('a')} AS first, {R('b')} AS second, {R('c')} AS selected, {R('g')} AS gain, {R('lo')} AS g_lo, {R('hi')} AS g_hi
      FROM (SELECT count(*) AS n, avg(marginal) AS a, avg(half) AS b, avg(c) AS c, avg(gain) AS g FROM pk),
        (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot)""",
    "fold_choices": f"{WIDE}, {_FOLDS} SELECT dataset, fold, CASE WHEN avg(half) > avg(marginal) THEN 'half' ELSE 'marginal' END AS choice FROM ff GROUP BY dataset, fold",
    "complete_cases": f"""{VIEWS}, ok AS (SELECT record_id, system, score FROM scored WHERE {_H} % 7 <> 0)
      SELECT count(*) AS n, {R('avg(a.score)')} AS first, {R('avg(b.score)')} AS second FROM ok a JOIN ok b ON a.record_id = b.record_id AND a.system = 'half' AND b.system = 'blend'""",
    "explorer_filter": _EXPORT + " " + " UNION ALL ".join(_VIEW.format(n=n, w=w) for n, w in _VIEW_FILTERS.items()),
    "explorer_page": _EXPORT
    + " "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{p}' AS page, question_id FROM ex WHERE kind = 'opinion_survey' ORDER BY {o}, question_id LIMIT 20)" for p, o in _PAGES.items()
    ),
    "explorer_search": f"{_EXPORT}, ws AS ({' UNION '.join(f'SELECT CAST({c} AS VARCHAR) AS pattern FROM {t}' for t, c in _WORDS.items())}) "
    f"SELECT pattern, count(*) AS n, {R('avg(os)')} AS ours, {R('avg(bs)')} AS base FROM ws JOIN ex ON contains(lower(question), lower(pattern)) GROUP BY pattern",
    "passage_search": f"WITH ws AS ({' UNION '.join(f'SELECT {c} AS pattern FROM {t}' for t, c in _PASSAGES.items())}) "
    "SELECT md5(pattern) AS pattern, doc_id FROM ws JOIN documents ON contains(lower(text), lower(pattern))",
    "keyword_rows": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'released') ORDER BY doc_id LIMIT 6",
    "distinct_families": f"{VIEWS} SELECT DISTINCT dataset, question FROM cell",
    "union_systems": f"{VIEWS} SELECT system, count(DISTINCT record_id) AS n, count(DISTINCT record_id) AS records FROM x WHERE system IN ('half', 'peaked') GROUP BY system",
    "spec_scores": f"""{VIEWS}, sp AS (
        SELECT 1 AS i, {_spec_hash('[]', 'half')} AS config_hash, 'half' AS predictor
        UNION ALL SELECT 2, {_spec_hash('["temp:temperature=2.0"]', 'half')}, 'half' UNION ALL SELECT 3, {_spec_hash('["dirichlet:alpha=0.1"]', 'peaked')}, 'peaked'),
      r AS (SELECT i, config_hash, predictor, record_id, opt, p, CASE i WHEN 1 THEN q WHEN 2 THEN sqrt(q) ELSE q + 0.1 END AS w FROM x JOIN sp ON sp.predictor = x.system),
      n AS (SELECT *, w / sum(w) OVER (PARTITION BY i, record_id) AS t FROM r),
      s AS (SELECT config_hash, predictor, record_id, sum(abs(p - t)) / 2 AS tvd FROM n GROUP BY ALL)
      SELECT config_hash, 'model_a' AS model, predictor, count(*) AS n, {R(_ROWSCORE)} AS score FROM s JOIN (SELECT record_id, tvd_u FROM truth) USING (record_id) GROUP BY config_hash, predictor""",
}
