"""Segments: shares, decompositions, post-stratification, counterfactual alignment, marginals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, rounded, scored
from plurality.catalog.ingest import PERSONAS
from plurality.functions import dist, keys
from plurality.operators import counterfactual, segments
from plurality.operators import evaluate as ev
from plurality.sources import tables


def distribution_table(spark, sf):
    out = segments.distribution_table(tables.cells(spark, sf))
    return rounded(out.select("record_id", "variables", "group_size", "weight"), "weight")


def grouping_counts(spark, sf):
    return segments.grouping_counts(tables.cells(spark, sf))


def child_weights(spark, sf):
    return rounded(segments.child_weights(tables.cells(spark, sf)), "weight")


def decompositions(spark, sf):
    return segments.decompositions(tables.cells(spark, sf))


def _long(cells, preds):
    rows = preds.join(cells.select("record_id", "options"), "record_id")
    v = dist.renorm(dist.align(F.col("pred"), F.col("options")))
    pairs = F.arrays_zip(F.col("options").alias("o"), v.alias("v"))
    return rows.select("record_id", "system", "decomposed", F.explode(pairs).alias("z")).select(
        "record_id", "system", "decomposed", F.col("z.o").alias("opt"), r6("z.v").alias("q")
    )


def post_strat(spark, sf):
    cells = tables.cells(spark, sf)
    return _long(cells, segments.post_stratify(cells, tables.predictions(spark, sf)))


def post_strat_over(spark, sf):
    cells = tables.cells(spark, sf)
    return _long(cells, segments.post_stratify(cells, tables.predictions(spark, sf), over="g2", min_children=3))


def post_strat_weights(spark, sf):
    """Recombination under a supplied weight table: the square roots of the respondent shares."""
    cells = tables.cells(spark, sf)
    weights = segments.child_weights(cells).withColumn("weight", F.sqrt("weight"))
    out = segments.recombine_weighted(weights, cells, tables.predictions(spark, sf))
    return out.select("record_id", "system", F.explode("pred").alias("opt", "q")).withColumn("q", r6("q"))


def _ragged(spark, sf):
    """All cells and predictions with the options of zero share dropped, every other record's list reversed."""
    cells = tables.cells(spark, sf)
    listed = F.filter("options", lambda o: F.element_at("truth", o) > 0)
    turned = F.when(keys.hash32(F.col("record_id")) % 2 == 0, F.reverse(listed)).otherwise(listed)
    cells = cells.withColumn("options", turned).withColumn("truth", F.map_filter("truth", lambda _, v: v > 0))
    preds = tables.predictions(spark, sf).join(cells.select("record_id", "options"), "record_id")
    preds = preds.withColumn("pred", F.map_filter("pred", lambda k, _: F.array_contains("options", k))).drop("options")
    return cells, preds


def post_strat_ragged(spark, sf):
    cells, preds = _ragged(spark, sf)
    return _long(cells, segments.post_stratify(cells, preds))


def post_strat_weights_ragged(spark, sf):
    cells, preds = _ragged(spark, sf)
    weights = segments.child_weights(cells).withColumn("weight", F.sqrt("weight"))
    out = segments.recombine_weighted(weights, cells, preds)
    return out.select("record_id", "system", F.explode("pred").alias("opt", "q")).withColumn("q", r6("q"))


def counterfactual_ragged(spark, sf):
    cells, preds = _ragged(spark, sf)
    out = counterfactual.segment_shifts(ev.evaluate(cells, preds)).select("record_id", "system", "alignment", "true_shift")
    return rounded(out, "alignment", "true_shift")


def post_strat_coverage(spark, sf):
    cells = tables.cells(spark, sf)
    out = segments.post_stratify(cells, tables.predictions(spark, sf))
    return out.groupBy("system").agg(
        F.count_if("decomposed").alias("n_decomposed"), F.count_if(~F.col("decomposed")).alias("n_fallback")
    )


def recombine_check(spark, sf):
    out = segments.recombination_summary(tables.cells(spark, sf))
    return rounded(out, "mean", "max", "median")


def counterfactual_rows(spark, sf):
    out = counterfactual.segment_shifts(scored(spark, sf)).select("record_id", "system", "alignment", "true_shift")
    return rounded(out, "alignment", "true_shift")


def counterfactual_mean(spark, sf):
    return rounded(counterfactual.alignment_by_system(counterfactual.segment_shifts(scored(spark, sf))), "cf_alignment")


def topline_alignment(spark, sf):
    """The comparison table with the counterfactual column."""
    rows = scored(spark, sf)
    alignment = counterfactual.alignment_by_system(counterfactual.segment_shifts(rows)).drop("n_aligned")
    out = ev.topline(rows, alignment, n_boot=200)
    return rounded(out.drop("ci_low", "ci_high"), "mean", "frac_below_uniform", "cf_alignment")


def marginal(spark, sf):
    out = segments.segment_marginal(tables.cells(spark, sf), "g2", ["dataset"])
    return rounded(out, "share")


def calib_weights(spark, sf):
    """Panels of personas per state, weighted so that their city mix follows the order customers' mix."""
    cells = tables.cells(spark, sf).filter(F.col("question") == "status")
    target = segments.segment_marginal(cells, "g2", vocabulary=["automobile", "building", "furniture"])
    panel = tables.personas(spark, sf).select("state", "uuid", F.lower("city").alias("label"))
    out = segments.marginal_weights(panel, target, ["state"], "uuid")
    return rounded(out, "panel_share", "weight")


QUERIES = {
    "distribution_table": distribution_table,
    "grouping_counts": grouping_counts,
    "child_weights": child_weights,
    "decompositions": decompositions,
    "post_strat": post_strat,
    "post_strat_over": post_strat_over,
    "post_strat_weights": post_strat_weights,
    "post_strat_coverage": post_strat_coverage,
    "recombine_check": recombine_check,
    "post_strat_ragged": post_strat_ragged,
    "post_strat_weights_ragged": post_strat_weights_ragged,
    "counterfactual_ragged": counterfactual_ragged,
    "counterfactual": counterfactual_rows,
    "counterfactual_mean": counterfactual_mean,
    "topline_alignment": topline_alignment,
    "marginal": marginal,
    "calib_weights": calib_weights,
}

_VARS = "CASE WHEN split = 'pop' THEN '' ELSE concat_ws(',', CASE WHEN g1 IS NOT NULL THEN 'g1' END, CASE WHEN g2 IS NOT NULL THEN 'g2' END) END"

KIDS = """kid AS (
  SELECT p.record_id AS parent_id, 'g1' AS var, c.record_id AS child_id, c.size FROM cell p JOIN cell c
    ON p.dataset = c.dataset AND p.question = c.question AND p.g1 IS NULL AND c.g1 IS NOT NULL AND p.g2 IS NOT DISTINCT FROM c.g2
  UNION ALL SELECT p.record_id, 'g2', c.record_id, c.size FROM cell p JOIN cell c
    ON p.dataset = c.dataset AND p.question = c.question AND p.g2 IS NULL AND c.g2 IS NOT NULL AND p.g1 IS NOT DISTINCT FROM c.g1),
cover AS (SELECT parent_id, var, sum(size) AS covered, count(*) AS n FROM kid GROUP BY ALL)"""


def _post(source: str, picked: str, minimum: int) -> str:
    """Long rows (record_id, system, opt, decomposed, q) of ``source`` rebuilt over the variable chosen by ``picked``."""
    return f"""{KIDS}, pick AS ({picked}),
      ok AS (SELECT pick.parent_id, pick.var FROM pick JOIN cover USING (parent_id, var) WHERE n >= {minimum}),
      mix AS (SELECT kid.parent_id, s.system, s.opt, sum(kid.size * s.q) / sum(kid.size) AS v FROM kid JOIN ok USING (parent_id, var)
        JOIN {source} s ON s.record_id = kid.child_id GROUP BY ALL),
      post AS (SELECT s.record_id, s.system, s.opt, s.p, m.v IS NOT NULL AS decomposed, coalesce(m.v / sum(m.v) OVER (PARTITION BY s.record_id, s.system), s.q) AS q
        FROM {source} s LEFT JOIN mix m ON m.parent_id = s.record_id AND m.system = s.system AND m.opt = s.opt)"""


_BEST = "SELECT parent_id, var FROM cover QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY covered DESC, var) = 1"

_SHIFT = """ref AS (SELECT system, dataset, question, opt, sum(size * p) / sum(size) AS rp, sum(size * q) / sum(size) AS rq, count(*) AS n FROM x GROUP BY ALL),
  sh AS (SELECT x.record_id, x.system, sqrt(sum((p - rp) ** 2)) AS np, sqrt(sum((q - rq) ** 2)) AS nq, sum((p - rp) * (q - rq)) AS dot
    FROM x JOIN ref USING (system, dataset, question, opt) WHERE n >= 2 GROUP BY x.record_id, x.system),
  al AS (SELECT record_id, system, np, CASE WHEN np < 1e-12 OR nq < 1e-12 THEN NULL ELSE dot / (np * nq) END AS alignment FROM sh)"""

# Cells that list only the options they have; a prediction states only those.
_RAGGED = """rg AS (SELECT record_id, dataset, question, system, opt, size, p, q FROM x WHERE p > 0),
  own AS (SELECT record_id, system, opt, CASE WHEN sum(q) OVER s > 0 THEN q / sum(q) OVER s ELSE 1.0 / count(*) OVER s END AS q FROM rg WINDOW s AS (PARTITION BY record_id, system))"""

# Parent options against the chosen cells, absent labels as zero.
_RAGGED_MIX = """SELECT par.record_id, par.system, par.opt, sum(c.weight * coalesce(ch.q, 0)) AS v
  FROM rg par JOIN chosen c ON c.parent_id = par.record_id
  LEFT JOIN rg ch ON ch.record_id = c.child_id AND ch.system = par.system AND ch.opt = par.opt GROUP BY ALL"""

_SHARED = "CASE WHEN sum(v) OVER s > 0 THEN v / sum(v) OVER s ELSE 1.0 / count(*) OVER s END"

SQL = {
    "post_strat_ragged": f"""{VIEWS}, {KIDS}, {_RAGGED}, pick AS ({_BEST}),
      chosen AS (SELECT kid.parent_id, child_id, size / covered AS weight FROM kid JOIN pick USING (parent_id, var) JOIN cover USING (parent_id, var) WHERE n >= 2),
      mix AS ({_RAGGED_MIX}), mixed AS (SELECT record_id, system, opt, {_SHARED} AS q FROM mix WINDOW s AS (PARTITION BY record_id, system))
      SELECT own.record_id, own.system, m.q IS NOT NULL AS decomposed, own.opt, {R('coalesce(m.q, own.q)')} AS q
      FROM own LEFT JOIN mixed m ON m.record_id = own.record_id AND m.system = own.system AND m.opt = own.opt""",
    "post_strat_weights_ragged": f"""{VIEWS}, {KIDS}, {_RAGGED},
      w AS (SELECT parent_id, var, child_id, sqrt(size / sum(size) OVER (PARTITION BY parent_id, var)) AS weight FROM kid),
      v AS (SELECT parent_id, var, sum(weight) AS c FROM w GROUP BY ALL HAVING count(*) >= 2),
      b AS (SELECT parent_id, var FROM v QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY c DESC, var) = 1),
      chosen AS (SELECT w.* FROM w JOIN b USING (parent_id, var)), mix AS ({_RAGGED_MIX})
      SELECT record_id, system, opt, {R(_SHARED)} AS q FROM mix WINDOW s AS (PARTITION BY record_id, system)""",
    "counterfactual_ragged": f"""{VIEWS}, {_RAGGED}, tp AS (SELECT record_id, system, opt, p / sum(p) OVER (PARTITION BY record_id, system) AS p FROM rg),
      fam AS (SELECT DISTINCT record_id, system, dataset, question, size FROM rg),
      tot AS (SELECT system, dataset, question, sum(size) AS total, count(*) AS n FROM fam GROUP BY ALL),
      ref AS (SELECT f.system, f.dataset, f.question, tp.opt, sum(f.size * tp.p) / any_value(tot.total) AS rp, sum(f.size * own.q) / any_value(tot.total) AS rq
        FROM fam f JOIN tp USING (record_id, system) JOIN own USING (record_id, system, opt) JOIN tot ON tot.system = f.system AND tot.dataset = f.dataset AND tot.question = f.question
        WHERE tot.n >= 2 GROUP BY ALL),
      sh AS (SELECT f.record_id, f.system, sqrt(sum((coalesce(tp.p, 0) - rp) ** 2)) AS np, sqrt(sum((coalesce(own.q, 0) - rq) ** 2)) AS nq,
          sum((coalesce(tp.p, 0) - rp) * (coalesce(own.q, 0) - rq)) AS dot
        FROM fam f JOIN ref ON ref.system = f.system AND ref.dataset = f.dataset AND ref.question = f.question
        LEFT JOIN tp ON tp.record_id = f.record_id AND tp.system = f.system AND tp.opt = ref.opt
        LEFT JOIN own ON own.record_id = f.record_id AND own.system = f.system AND own.opt = ref.opt GROUP BY ALL)
      SELECT record_id, system, {R('CASE WHEN np < 1e-12 OR nq < 1e-12 THEN NULL ELSE dot / (np * nq) END')} AS alignment, {R('np')} AS true_shift FROM sh""",
    "distribution_table": f"""{VIEWS}, v AS (SELECT *, {_VARS} AS variables FROM cell)
      SELECT record_id, variables, CAST(size AS BIGINT) AS group_size, {R('size / sum(size) OVER (PARTITION BY dataset, question, variables)')} AS weight FROM v""",
    "grouping_counts": f"{VIEWS} SELECT {_VARS} AS variables, count(*) AS n FROM cell GROUP BY ALL ORDER BY n DESC, variables LIMIT 10",
    "child_weights": f"{VIEWS}, {KIDS} SELECT parent_id, var, child_id, {R('size / sum(size) OVER (PARTITION BY parent_id, var)')} AS weight FROM kid",
    "decompositions": f"""{VIEWS}, {KIDS} SELECT parent_id, coalesce(string_agg(var, ',' ORDER BY var) FILTER (WHERE n >= 2), '') AS variables,
      arg_min(var, (-covered, var)) AS picked FROM cover GROUP BY parent_id""",
    "post_strat": f"{VIEWS}, {_post('x', _BEST, 2)} SELECT record_id, system, decomposed, opt, {R('q')} AS q FROM post",
    "post_strat_over": f"""{VIEWS}, {_post('x', "SELECT parent_id, var FROM cover WHERE var = 'g2'", 3)}
      SELECT record_id, system, decomposed, opt, {R('q')} AS q FROM post""",
    "post_strat_weights": f"""{VIEWS}, {KIDS}, w AS (SELECT parent_id, var, child_id, sqrt(size / sum(size) OVER (PARTITION BY parent_id, var)) AS weight FROM kid),
      v AS (SELECT parent_id, var, sum(weight) AS c FROM w GROUP BY ALL HAVING count(*) >= 2),
      b AS (SELECT parent_id, var FROM v QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY c DESC, var) = 1),
      m AS (SELECT w.parent_id AS record_id, x.system, x.opt, sum(weight * q) AS s FROM w JOIN b USING (parent_id, var) JOIN x ON x.record_id = w.child_id GROUP BY ALL)
      SELECT record_id, system, opt, {R('s / sum(s) OVER (PARTITION BY record_id, system)')} AS q FROM m""",
    "post_strat_coverage": f"""{VIEWS}, {_post('x', _BEST, 2)}, d AS (SELECT record_id, system, bool_or(decomposed) AS d FROM post GROUP BY ALL)
      SELECT system, count(*) FILTER (WHERE d) AS n_decomposed, count(*) FILTER (WHERE NOT d) AS n_fallback FROM d GROUP BY system""",
    "recombine_check": f"""{VIEWS}, tx AS (SELECT record_id, 'truth' AS system, opt, p, p AS q FROM cl), {_post('tx', _BEST, 2)},
      e AS (SELECT record_id, sum(abs(p - q)) / 2 AS tvd FROM post WHERE decomposed GROUP BY record_id)
      SELECT count(*) AS n, {R('avg(tvd)')} AS mean, {R('max(tvd)')} AS max, {R('quantile_cont(tvd, 0.5)')} AS median FROM e""",
    "counterfactual": f"{VIEWS}, {_SHIFT} SELECT record_id, system, {R('alignment')} AS alignment, {R('np')} AS true_shift FROM al",
    "counterfactual_mean": f"{VIEWS}, {_SHIFT} SELECT system, {R('avg(alignment)')} AS cf_alignment, count(alignment) AS n_aligned FROM al GROUP BY system",
    "topline_alignment": f"""{VIEWS}, {_SHIFT}, a AS (SELECT system, avg(alignment) AS ca FROM al GROUP BY system)
      SELECT system, count(*) AS n, {R('avg(score)')} AS mean, {R('avg((score < 0)::INT)')} AS frac_below_uniform, {R('any_value(ca)')} AS cf_alignment
      FROM scored LEFT JOIN a USING (system) GROUP BY system""",
    "marginal": f"""{VIEWS} SELECT dataset, lower(trim(g2)) AS label, {R('sum(size) / sum(sum(size)) OVER (PARTITION BY dataset)')} AS share
      FROM cell WHERE g1 IS NULL AND g2 IS NOT NULL GROUP BY dataset, lower(trim(g2))""",
    "calib_weights": f"""{VIEWS}, {PERSONAS}, m AS (SELECT lower(g2) AS label, sum(size) AS size FROM cell WHERE g1 IS NULL AND g2 IS NOT NULL AND question = 'status' GROUP BY ALL),
      t AS (SELECT label, size / sum(size) OVER () AS share FROM m WHERE label IN ('automobile', 'building', 'furniture')),
      p AS (SELECT state, uuid, lower(city) AS label, count(*) OVER (PARTITION BY state, city) / count(*) OVER (PARTITION BY state) AS ps FROM personas),
      w AS (SELECT p.*, coalesce(share, 0) / ps AS r FROM p LEFT JOIN t USING (label))
      SELECT state, uuid, label, {R('ps')} AS panel_share,
        {R('CASE WHEN sum(r) OVER (PARTITION BY state) > 0 THEN r / sum(r) OVER (PARTITION BY state) ELSE 1.0 / count(*) OVER (PARTITION BY state) END')} AS weight FROM w""",
}
