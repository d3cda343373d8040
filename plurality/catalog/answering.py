"""Predictions read out of responses: parsing, votes, draws, blends, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, rounded, scored
from plurality.catalog.ingest import KINDS
from plurality.functions import dist
from plurality.operators import calibrate, draws
from plurality.operators.export import kind_of
from plurality.sources import tables

BLEND = {"marginal": 0.3, "half": 0.5, "peaked": 0.2}
ROUTES = {"opinion_survey": "half", "risky_choice": "uniform", "knowledge": "blend"}
MIX_GRID = tuple(i / 10 for i in range(11))


def _long(preds, *keep):
    return preds.select("record_id", *keep, F.explode("pred").alias("opt", "q")).withColumn("q", r6("q"))


def parse_dist(spark, sf):
    out = draws.parse_predictions(tables.completions(spark, sf), tables.cells(spark, sf))
    rows = out.join(tables.cells(spark, sf).select("record_id", "options"), "record_id")
    v = dist.renorm(dist.align(F.col("pred"), F.col("options")))
    return _long(rows.withColumn("pred", dist.as_map(F.col("options"), v)), "system", "parse_failed")


def vote_tally(spark, sf):
    return _long(draws.tally_votes(tables.votes(spark, sf), tables.cells(spark, sf)), "n_votes", "n_failed")


def parse_vote(spark, sf):
    """Votes per option and unreadable votes, over every answer."""
    cells = tables.cells(spark, sf)
    texts = tables.votes(spark, sf).groupBy("record_id", "text").agg(F.count(F.lit(1)).alias("n"))
    from plurality.functions.text import vote

    parsed = texts.join(cells.select("record_id", "dataset", "options"), "record_id")
    return parsed.groupBy("dataset", vote(F.col("text"), F.col("options")).alias("vote")).agg(F.sum("n").alias("n"))


def _parsed(spark, sf):
    return draws.parse_draws(tables.draws(spark, sf), tables.cells(spark, sf))


def avg_draws(spark, sf):
    return _long(draws.average_draws(_parsed(spark, sf)), "n_ok", "n_failed")


def weighted_draws(spark, sf):
    """Draw i weighs i, so the first draw has no say."""
    return _long(draws.average_draws(_parsed(spark, sf), F.col("draw").cast("double")), "n_ok", "n_failed")


def coverage(spark, sf):
    return rounded(draws.coverage(_parsed(spark, sf), ["draw"], F.col("v").isNotNull()), "fallback_rate")


def blend(spark, sf):
    out = draws.blend(tables.predictions(spark, sf), tables.cells(spark, sf), BLEND)
    return _long(out, "system")


def blend_sweep(spark, sf):
    rows = scored(spark, sf)
    out = draws.blend_sweep(rows, "half", "peaked", MIX_GRID)
    return rounded(out, "score", "pred_h")


def route(spark, sf):
    kinds = tables.cells(spark, sf).select("record_id", kind_of(F.col("dataset"), KINDS).alias("kind"))
    return _long(draws.route(kinds, tables.predictions(spark, sf), ROUTES, "marginal"), "kind", "routed_to")


def route_counts(spark, sf):
    kinds = tables.cells(spark, sf).select("record_id", kind_of(F.col("dataset"), KINDS).alias("kind"))
    out = draws.route(kinds, tables.predictions(spark, sf), ROUTES, "marginal")
    return out.groupBy("kind", "routed_to").agg(F.count(F.lit(1)).alias("n"))


def inter_tvd(spark, sf):
    return rounded(draws.draw_spread(_parsed(spark, sf)), "inter_tvd")


def panel_diversity(spark, sf):
    return rounded(draws.panel_diversity(_parsed(spark, sf), min_draws=3), "inter_tvd", "mode_agreement")


def k_curve(spark, sf):
    rows = scored(spark, sf).filter(F.col("system") == "half").select("record_id", "p", "z")
    return rounded(draws.size_curve(_parsed(spark, sf), rows, [1, 2, 3, 5], repeats=25), "score")


QUERIES = {
    "parse_dist": parse_dist,
    "parse_vote": parse_vote,
    "vote_tally": vote_tally,
    "avg_draws": avg_draws,
    "weighted_draws": weighted_draws,
    "coverage": coverage,
    "blend": blend,
    "blend_sweep": blend_sweep,
    "route": route,
    "route_counts": route_counts,
    "inter_tvd": inter_tvd,
    "panel_diversity": panel_diversity,
    "k_curve": k_curve,
}


def _h(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 8))::UBIGINT"


_KIND = "CASE dataset " + " ".join(f"WHEN '{d}' THEN '{k}'" for d, k in KINDS.items()) + " ELSE 'other' END"
_ROUTE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in ROUTES.items()) + " ELSE 'marginal' END"
_KINDED = f"kd AS (SELECT *, {_ROUTE} AS routed_to FROM (SELECT *, {_KIND} AS kind FROM x))"

_DRAWS = f"""dr AS (SELECT record_id, opt, pos, k, p, list_position(['uniform', 'marginal', 'half', 'blend', 'peaked'], system) - 1 AS draw, q FROM x),
  dx AS (SELECT *, {_h("record_id || '::' || draw")} % 7 <> 0 AS ok FROM dr)"""
_COUNTS = """SELECT record_id, CAST(count(DISTINCT draw) FILTER (WHERE ok) AS BIGINT) AS n_ok, CAST(count(DISTINCT draw) FILTER (WHERE NOT ok) AS BIGINT) AS n_failed FROM dx GROUP BY record_id"""

_VOTES = f"""vr AS (SELECT dataset || '|' || question || '|g1=' || g1 || '|g2=' || g2 AS record_id, dataset, opt, half FROM resp),
  vv AS (SELECT record_id, dataset, CASE WHEN half = 0 OR {_h("record_id || '::' || opt")} % 5 <> 0 THEN opt END AS vote FROM vr)"""


def _mean(weight: str) -> str:
    return f"""{VIEWS}, {_DRAWS}, c AS ({_COUNTS}),
      s AS (SELECT record_id, opt, any_value(k) AS k, coalesce(sum({weight} * q) FILTER (WHERE ok), 0) AS s FROM dx GROUP BY record_id, opt),
      n AS (SELECT *, sum(s) OVER (PARTITION BY record_id) AS t FROM s)
      SELECT record_id, opt, {R('CASE WHEN t > 0 THEN s / t ELSE 1.0 / k END')} AS q, n_ok, n_failed FROM n JOIN c USING (record_id)"""


_SPREAD = f"""{VIEWS}, {_DRAWS}, pr AS (SELECT a.record_id, a.draw AS i, b.draw AS j, sum(abs(a.q - b.q)) / 2 AS tvd FROM dx a JOIN dx b
    ON a.record_id = b.record_id AND a.opt = b.opt AND a.draw < b.draw WHERE a.ok AND b.ok GROUP BY ALL),
  sp AS (SELECT record_id, avg(tvd) AS inter_tvd FROM pr GROUP BY record_id),
  nd AS (SELECT record_id, count(DISTINCT draw) AS n_draws FROM dx WHERE ok GROUP BY record_id)"""

SQL = {
    "parse_dist": f"""{VIEWS}, b AS (SELECT *, {_h("record_id || '::' || system")} % 7 = 0 AS bad FROM x)
      SELECT record_id, system, bad AS parse_failed, opt, {R('CASE WHEN bad THEN 1.0 / k ELSE q END')} AS q FROM b""",
    "parse_vote": f"{VIEWS}, {_VOTES} SELECT dataset, vote, count(*) AS n FROM vv GROUP BY ALL",
    "vote_tally": f"""{VIEWS}, {_VOTES}, t AS (SELECT record_id, count(vote) AS n_votes, count(*) - count(vote) AS n_failed FROM vv GROUP BY record_id),
      o AS (SELECT record_id, vote, count(*) AS n FROM vv WHERE vote IS NOT NULL GROUP BY ALL)
      SELECT cl.record_id, cl.opt, {R('CASE WHEN n_votes = 0 THEN 1.0 / k ELSE (coalesce(o.n, 0) + 0.5) / (n_votes + 0.5 * k) END')} AS q, n_votes, n_failed
      FROM cl JOIN t USING (record_id) LEFT JOIN o ON o.record_id = cl.record_id AND o.vote = cl.opt""",
    "avg_draws": _mean("1"),
    "weighted_draws": _mean("draw"),
    "coverage": f"""{VIEWS}, {_DRAWS}, d AS (SELECT DISTINCT record_id, draw, ok FROM dx)
      SELECT draw, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, {R('avg((NOT ok)::INT)')} AS fallback_rate FROM d GROUP BY draw""",
    "blend": f"""{VIEWS} SELECT record_id, 'ensemble' AS system, opt,
      {R("sum(q * CASE system WHEN 'marginal' THEN 0.3 WHEN 'half' THEN 0.5 WHEN 'peaked' THEN 0.2 ELSE 0 END)")} AS q FROM x GROUP BY record_id, opt""",
    "blend_sweep": f"""{VIEWS}, w AS (SELECT record_id, opt, k, p, max(q) FILTER (WHERE system = 'half') AS a, max(q) FILTER (WHERE system = 'peaked') AS b FROM x GROUP BY ALL),
      m AS (SELECT record_id, weight, k, p, weight * a + (1 - weight) * b AS q FROM w, (SELECT CAST(i AS DOUBLE) / 10 AS weight FROM range(11) t(i))),
      s AS (SELECT record_id, weight, sum(abs(p - q)) / 2 AS tvd, CASE WHEN count(*) FILTER (WHERE q > 0) <= 1 THEN 0.0 ELSE -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(any_value(k)) END AS h
        FROM m GROUP BY ALL)
      SELECT weight, count(*) AS n, {R('avg(CASE WHEN z <= 0 THEN 0 ELSE 100 * (1 - s.tvd / z) END)')} AS score, {R('avg(h)')} AS pred_h
      FROM s JOIN (SELECT record_id, z FROM truth JOIN norm USING (split, dataset)) USING (record_id) GROUP BY weight""",
    "route": f"{VIEWS}, {_KINDED} SELECT record_id, kind, routed_to, opt, {R('q')} AS q FROM kd WHERE system = routed_to",
    "route_counts": f"{VIEWS}, {_KINDED} SELECT kind, routed_to, count(DISTINCT record_id) AS n FROM kd GROUP BY ALL",
    "inter_tvd": f"{_SPREAD} SELECT record_id, n_draws, {R('inter_tvd')} AS inter_tvd FROM sp JOIN nd USING (record_id)",
    "panel_diversity": f"""{_SPREAD}, md AS (SELECT record_id, draw, list(q ORDER BY pos) AS ql FROM dx WHERE ok GROUP BY ALL),
      mm AS (SELECT record_id, list_position([v >= list_max(ql) - 1e-12 FOR v IN ql], true) AS m, count(*) AS n FROM md GROUP BY ALL),
      ma AS (SELECT record_id, max(n) / sum(n) AS mode_agreement FROM mm GROUP BY record_id)
      SELECT record_id, n_draws, {R('inter_tvd')} AS inter_tvd, {R('mode_agreement')} AS mode_agreement FROM sp JOIN nd USING (record_id) JOIN ma USING (record_id) WHERE n_draws >= 3""",
    "k_curve": f"""{VIEWS}, {_DRAWS}, dd AS (SELECT DISTINCT record_id, draw FROM dx WHERE ok),
      rk AS (SELECT record_id, draw, rep, row_number() OVER (PARTITION BY record_id, rep ORDER BY sha256('0::' || record_id || '::' || rep || '::' || draw)) AS r FROM dd, range(25) t(rep)),
      sz AS (SELECT rk.*, size FROM rk, (VALUES (1), (2), (3), (5)) s(size) WHERE r <= size),
      av AS (SELECT sz.record_id, rep, sz.size, opt, avg(q) AS q, any_value(p) AS p FROM sz JOIN dx ON dx.record_id = sz.record_id AND dx.draw = sz.draw GROUP BY ALL),
      sc AS (SELECT record_id, rep, size, sum(abs(p - q)) / 2 AS tvd FROM av GROUP BY ALL),
      pr AS (SELECT record_id, sc.size, avg(CASE WHEN z <= 0 THEN 0 ELSE 100 * (1 - tvd / z) END) AS s FROM sc JOIN (SELECT record_id, z FROM truth JOIN norm USING (split, dataset)) USING (record_id) GROUP BY ALL)
      SELECT size, count(*) AS n, {R('avg(s)')} AS score FROM pr GROUP BY size""",
}
