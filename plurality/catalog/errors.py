"""Error decomposition and the diagnostic breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, rounded, scored
from plurality.catalog.ingest import KINDS
from plurality.operators import decompose, diagnostics, splits
from plurality.operators.export import kind_of
from plurality.plans.lineage import stored
from plurality.sources import tables


def decomposed(spark, sf):
    return decompose.decompose(scored(spark, sf))


def error_decomp(spark, sf):
    rows = decomposed(spark, sf).select(
        "record_id", "system", "tvd", "conc", "loc", "pred_entropy", "entropy_gap", "mode_match", "mode_mass_err"
    )
    return rounded(rows, "tvd", "conc", "loc", "pred_entropy", "entropy_gap", "mode_mass_err")


def score_losses(spark, sf):
    rows = decomposed(spark, sf).select("record_id", "system", "score", "score_loss", "conc_loss", "loc_loss")
    return rounded(rows, "score", "score_loss", "conc_loss", "loc_loss")


_MEANS = (
    "mean_tvd conc_err loc_err entropy_gap mode_acc mode_mass_err score_loss conc_loss loc_loss conc_share loc_share"
).split()


def system_summary(spark, sf):
    return rounded(decompose.system_summary(decomposed(spark, sf), ["system", "split"]), *_MEANS)


def gain_attribution(spark, sf):
    grouped = decomposed(spark, sf).filter(F.col("split") == "grouped")
    out = decompose.gain_attribution(decompose.system_summary(grouped), "marginal")
    return rounded(out, "d_score", "d_conc", "d_loc")


def best_typical_worst(spark, sf):
    rows = decomposed(spark, sf).select("system", "split", "record_id", "tvd", "conc", "loc")
    return rounded(decompose.best_typical_worst(stored(rows, "facets")), "tvd", "conc", "loc")


def entropy_thirds(spark, sf):
    return rounded(diagnostics.entropy_thirds(scored(spark, sf)), "score")


def entropy_tertiles(spark, sf):
    return rounded(diagnostics.entropy_tertiles(decomposed(spark, sf)), "low", "mid", "high")


def entropy_curve(spark, sf):
    return rounded(diagnostics.entropy_curve(scored(spark, sf)), "score", "mid")


def entropy_curve_min5(spark, sf):
    return rounded(diagnostics.entropy_curve(scored(spark, sf), min_count=5), "score", "mid")


def reliability(spark, sf):
    return rounded(diagnostics.reliability(scored(spark, sf)), "mean_pred", "mean_truth")


def score_hist(spark, sf):
    return diagnostics.score_histogram(scored(spark, sf))


def score_hist_wide(spark, sf):
    return diagnostics.score_histogram_wide(scored(spark, sf))


def by_n_options(spark, sf):
    out = scored(spark, sf).groupBy("system", "n_options").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return rounded(out, "mean")


def pooled_questions(spark, sf):
    tagged = splits.rows_by_rule(scored(spark, sf), "question", {"status": "status", "flag": "flag", "lang": "lang"})
    return rounded(diagnostics.pooled_questions(tagged), "human", "predicted")


def mean_entropy(spark, sf):
    rows = decomposed(spark, sf).withColumn("task_kind", kind_of(F.col("dataset"), KINDS))
    return rounded(diagnostics.mean_entropy(rows, ["task_kind", "system"]), "human_entropy", "pred_entropy")


def dataset_split_counts(spark, sf):
    return diagnostics.dataset_split_counts(tables.cells(spark, sf))


def option_counts(spark, sf):
    return diagnostics.option_counts(tables.cells(spark, sf))


def entropy_profile(spark, sf):
    return rounded(diagnostics.entropy_profile(tables.cells(spark, sf)), "mean", "std", "contested")


def entropy_histogram(spark, sf):
    return diagnostics.entropy_histogram(tables.cells(spark, sf))


def entropy_extremes(spark, sf):
    return diagnostics.entropy_extremes(tables.cells(spark, sf))


def family_entropy(spark, sf):
    out = diagnostics.family_entropy(tables.cells(spark, sf))
    return rounded(out, "pop_entropy", "mean_group_entropy", "std_group_entropy", "entropy_range")


def family_entropy_by_dataset(spark, sf):
    out = diagnostics.family_entropy_by_dataset(diagnostics.family_entropy(tables.cells(spark, sf)))
    return rounded(out, "mean_groups", "mean_range", "max_range")


def top_entropy_range(spark, sf):
    top = diagnostics.family_entropy(tables.cells(spark, sf)).withColumn("entropy_range", r6("entropy_range"))
    return top.orderBy(F.desc("entropy_range"), "dataset", "question").limit(5).select("dataset", "question", "n_groups", "entropy_range")


def mechanism_diagnostics(spark, sf):
    out = diagnostics.mechanism_diagnostics(decomposed(spark, sf))
    return rounded(out, "pred_h", "slope", "commit_rate", "mode_acc", "floor_p10")


QUERIES = {
    "error_decomp": error_decomp,
    "score_losses": score_losses,
    "system_summary": system_summary,
    "gain_attribution": gain_attribution,
    "best_typical_worst": best_typical_worst,
    "entropy_thirds": entropy_thirds,
    "entropy_tertiles": entropy_tertiles,
    "entropy_curve": entropy_curve,
    "entropy_curve_min5": entropy_curve_min5,
    "reliability": reliability,
    "score_hist": score_hist,
    "score_hist_wide": score_hist_wide,
    "by_n_options": by_n_options,
    "pooled_questions": pooled_questions,
    "mean_entropy": mean_entropy,
    "dataset_split_counts": dataset_split_counts,
    "option_counts": option_counts,
    "entropy_profile": entropy_profile,
    "entropy_histogram": entropy_histogram,
    "entropy_extremes": entropy_extremes,
    "family_entropy": family_entropy,
    "family_entropy_by_dataset": family_entropy_by_dataset,
    "top_entropy_range": top_entropy_range,
    "diagnostics": mechanism_diagnostics,
}

DEC = f"""{VIEWS}, vec AS (SELECT record_id, system, list(p ORDER BY pos) AS pl, list(q ORDER BY pos) AS ql FROM x GROUP BY record_id, system),
shape AS (SELECT record_id, system, list_sum([abs(list_reverse_sort(pl)[i] - list_reverse_sort(ql)[i]) FOR i IN range(1, len(pl) + 1)]) / 2 AS conc,
  list_position([v >= list_max(pl) - 1e-12 FOR v IN pl], true) AS pm, list_position([v >= list_max(ql) - 1e-12 FOR v IN ql], true) AS qm, pl, ql FROM vec),
dec AS (SELECT s.*, h.conc, greatest(0, s.tvd - h.conc) AS loc, s.pe - s.te AS gap, h.pm = h.qm AS mm, h.ql[h.pm] - h.pl[h.pm] AS mme,
  CASE WHEN s.z > 0 THEN 100 * s.tvd / s.z END AS score_loss, CASE WHEN s.z > 0 THEN 100 * h.conc / s.z END AS conc_loss,
  CASE WHEN s.z > 0 THEN 100 * greatest(0, s.tvd - h.conc) / s.z END AS loc_loss
  FROM scored s JOIN shape h ON s.record_id = h.record_id AND s.system = h.system)
"""

_SUM = """SELECT {g}, count(*) AS n, avg(tvd) AS mean_tvd, avg(conc) AS conc_err, avg(loc) AS loc_err, avg(gap) AS entropy_gap,
  avg(mm::INT) AS mode_acc, avg(mme) AS mode_mass_err, avg(score_loss) AS score_loss, avg(conc_loss) AS conc_loss, avg(loc_loss) AS loc_loss,
  avg(conc) / nullif(avg(tvd), 0) AS conc_share, avg(loc) / nullif(avg(tvd), 0) AS loc_share FROM {t} GROUP BY {g}"""

_KIND = "CASE dataset " + " ".join(f"WHEN '{d}' THEN '{k}'" for d, k in KINDS.items()) + " ELSE 'other' END"
_FAMILY = f"""{VIEWS}, fe AS (SELECT dataset, question, max(te) FILTER (WHERE split = 'pop') AS pop_entropy, avg(te) FILTER (WHERE split = 'grouped') AS mean_group_entropy,
  stddev_pop(te) FILTER (WHERE split = 'grouped') AS std_group_entropy, max(te) FILTER (WHERE split = 'grouped') - min(te) FILTER (WHERE split = 'grouped') AS entropy_range,
  count(*) FILTER (WHERE split = 'grouped') AS n_groups FROM truth GROUP BY dataset, question)"""

SQL = {
    "error_decomp": f"""{DEC} SELECT record_id, system, {R('tvd')} AS tvd, {R('conc')} AS conc, {R('loc')} AS loc, {R('pe')} AS pred_entropy,
      {R('gap')} AS entropy_gap, mm AS mode_match, {R('mme')} AS mode_mass_err FROM dec""",
    "score_losses": f"""{DEC} SELECT record_id, system, {R('score')} AS score, {R('score_loss')} AS score_loss, {R('conc_loss')} AS conc_loss,
      {R('loc_loss')} AS loc_loss FROM dec""",
    "system_summary": f"""{DEC} SELECT system, split, n, {', '.join(R(c) + ' AS ' + c for c in _MEANS)} FROM ({_SUM.format(g='system, split', t='dec')})""",
    "gain_attribution": f"""{DEC}, s AS ({_SUM.format(g='system', t="(SELECT * FROM dec WHERE split = 'grouped')")}), b AS (SELECT * FROM s WHERE system = 'marginal')
      SELECT s.system, {R('b.score_loss - s.score_loss')} AS d_score, {R('b.conc_loss - s.conc_loss')} AS d_conc, {R('b.loc_loss - s.loc_loss')} AS d_loc,
        CASE WHEN abs(b.conc_loss - s.conc_loss) > abs(b.loc_loss - s.loc_loss) THEN 'concentration' ELSE 'location' END AS driver
      FROM s, b WHERE s.system <> 'marginal'""",
    "best_typical_worst": f"""{DEC}, o AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY {R('tvd')}, sha256('0::' || record_id)) AS rn,
        count(*) OVER (PARTITION BY system) AS n FROM dec WHERE split = 'grouped')
      SELECT system, CASE WHEN rn = 1 THEN 'best' WHEN rn = n THEN 'worst' ELSE 'typical' END AS fit, record_id, {R('tvd')} AS tvd, {R('conc')} AS conc, {R('loc')} AS loc
      FROM o WHERE rn IN (1, n, n // 2 + 1)""",
    "entropy_thirds": f"""{VIEWS} SELECT system, CASE WHEN te <= 0.33 THEN 'low' WHEN te <= 0.66 THEN 'mid' ELSE 'high' END AS third, count(*) AS n,
      {R('avg(score)')} AS score FROM scored GROUP BY ALL""",
    "entropy_tertiles": f"""{DEC}, g AS (SELECT * FROM dec WHERE split = 'grouped'), e AS (SELECT quantile_cont(te, 1.0/3) AS a, quantile_cont(te, 2.0/3) AS b FROM g)
      SELECT system, {R('100 - avg(score_loss) FILTER (WHERE te <= a + 1e-9)')} AS low,
        {R('100 - avg(score_loss) FILTER (WHERE te > a + 1e-9 AND te <= b + 1e-9)')} AS mid,
        {R('100 - avg(score_loss) FILTER (WHERE te > b + 1e-9)')} AS high FROM g, e GROUP BY system""",
    "entropy_curve": f"""{VIEWS} SELECT system, bin, count(*) AS n, {R('avg(score)')} AS score, {R('(bin - 0.5) / 8')} AS mid
      FROM (SELECT *, CAST(floor((te + 1e-9) * 8) AS INT) + 1 AS bin FROM scored) WHERE bin <= 8 GROUP BY system, bin""",
    "entropy_curve_min5": f"""{VIEWS} SELECT system, bin, count(*) AS n, {R('avg(score)')} AS score, {R('(bin - 0.5) / 8')} AS mid
      FROM (SELECT *, CAST(floor((te + 1e-9) * 8) AS INT) + 1 AS bin FROM scored) WHERE bin <= 8 GROUP BY system, bin HAVING count(*) >= 5""",
    "reliability": f"""{VIEWS} SELECT system, bin, count(*) AS n, {R('avg(q)')} AS mean_pred, {R('avg(p)')} AS mean_truth
      FROM (SELECT *, CAST(floor((q + 1e-9) * 10) AS INT) + 1 AS bin FROM x) WHERE bin <= 10 GROUP BY system, bin""",
    "score_hist": f"""{VIEWS}, c AS (SELECT system, greatest(score, -100) AS s FROM scored), r AS (SELECT system, min(s) AS lo, max(s) AS hi FROM c GROUP BY system)
      SELECT system, CAST(least(39, floor((s - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 40 + 1e-9)) AS INT) AS bin, count(*) AS n
      FROM c JOIN r USING (system) GROUP BY ALL""",
    "score_hist_wide": f"""{VIEWS}, l AS (SELECT floor(least(0, min(score)) / 20) * 20 AS lo FROM scored)
      SELECT system, CAST(greatest(0, least((100 - lo) // 20 - 1, floor((score - lo) / 20 + 1e-9))) * 20 + lo AS INT) AS edge, count(*) AS n FROM scored, l GROUP BY ALL""",
    "by_n_options": f"{VIEWS} SELECT system, k AS n_options, count(*) AS n, {R('avg(score)')} AS mean FROM scored GROUP BY ALL",
    "pooled_questions": f"""{VIEWS}, t AS (SELECT rule, x.* FROM x, (VALUES ('status'), ('flag'), ('lang')) r(rule) WHERE contains(lower(question), rule)),
      s AS (SELECT rule, system, opt, sum(size * p) AS p, sum(size * q) AS q FROM t GROUP BY ALL)
      SELECT rule, system, opt AS option, {R('p / sum(p) OVER w')} AS human, {R('q / sum(q) OVER w')} AS predicted FROM s WINDOW w AS (PARTITION BY rule, system)""",
    "mean_entropy": f"{VIEWS} SELECT {_KIND} AS task_kind, system, {R('avg(te)')} AS human_entropy, {R('avg(pe)')} AS pred_entropy FROM scored GROUP BY ALL",
    "dataset_split_counts": f"""{VIEWS} SELECT dataset, count(*) FILTER (WHERE split = 'pop') AS pop, count(*) FILTER (WHERE split = 'grouped') AS "grouped" FROM cell GROUP BY dataset""",
    "option_counts": f"{VIEWS} SELECT k AS n_options, count(*) AS records FROM truth GROUP BY k",
    "entropy_profile": f"""{VIEWS}, e AS (SELECT quantile_cont(te, 2.0/3) AS u FROM truth WHERE split = 'pop')
      SELECT split, count(*) AS n, {R('avg(te)')} AS mean, {R('stddev_samp(te)')} AS std, {R('avg((te + 1e-9 >= u)::INT)')} AS contested FROM truth, e GROUP BY split""",
    "entropy_histogram": f"{VIEWS} SELECT split, CAST(least(40, floor((te + 1e-9) * 40) + 1) AS INT) AS bin, count(*) AS n FROM truth GROUP BY ALL",
    "entropy_extremes": f"""{VIEWS}, h AS (SELECT record_id, {R('te')} AS h FROM truth WHERE split = 'pop')
      SELECT * FROM (SELECT record_id, h, 'consensus' AS "end" FROM h ORDER BY h, record_id LIMIT 3)
      UNION ALL SELECT * FROM (SELECT record_id, h, 'contested' FROM h ORDER BY h DESC, record_id LIMIT 3)""",
    "family_entropy": f"""{_FAMILY} SELECT dataset, question, {R('pop_entropy')} AS pop_entropy, {R('mean_group_entropy')} AS mean_group_entropy,
      {R('std_group_entropy')} AS std_group_entropy, {R('entropy_range')} AS entropy_range, n_groups FROM fe""",
    "family_entropy_by_dataset": f"""{_FAMILY} SELECT dataset, {R('avg(n_groups)')} AS mean_groups, max(n_groups) AS max_groups, {R('avg(entropy_range)')} AS mean_range,
      {R('max(entropy_range)')} AS max_range FROM fe GROUP BY dataset""",
    "top_entropy_range": f"""{_FAMILY} SELECT dataset, question, n_groups, {R('entropy_range')} AS entropy_range FROM fe ORDER BY 4 DESC, dataset, question LIMIT 5""",
    "diagnostics": f"""{DEC} SELECT system, {R('avg(pe)')} AS pred_h, {R('regr_slope(pe, te)')} AS slope, {R('avg((pe < 0.45)::INT) FILTER (WHERE te < 0.4)')} AS commit_rate,
      {R('avg(mm::INT)')} AS mode_acc, {R('quantile_cont(pe, 0.1)')} AS floor_p10 FROM dec WHERE split = 'grouped' GROUP BY system""",
}
