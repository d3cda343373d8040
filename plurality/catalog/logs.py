"""Run logs and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, rounded, scored
from plurality.operators import runlog
from plurality.plans.lineage import scratch
from plurality.sources import survey, tables

PRICES = {"model_click": (0.10, 0.40), "model_view": (1.5, 9.0), "model_error": (0.25, 1.5)}
ETA = 1.0


def nodes(spark, sf):
    rows = runlog.with_paths(tables.run_log(spark, sf))
    return rows.select(
        "run_id", "node_id", "depth", F.array_join("path", ">").alias("path"), F.array_join("lever_path", ">").alias("levers"), "val_score"
    )


def progression(spark, sf):
    return runlog.progression(tables.run_log(spark, sf))


def running_cost(spark, sf):
    out = runlog.running_cost(tables.run_log(spark, sf)).select("run_id", "node_id", "cum_cost_usd")
    return rounded(out, "cum_cost_usd")


def ladder_replay(spark, sf):
    return runlog.gate_replay(tables.run_log(spark, sf), F.lit(ETA))


def config_lookup(spark, sf):
    return runlog.config_lookup(tables.run_log(spark, sf))


def log_summary(spark, sf):
    return rounded(runlog.log_summary(tables.run_log(spark, sf)), "total_cost")


def tree(spark, sf):
    return runlog.tree_lines(tables.run_log(spark, sf))


def subtree_totals(spark, sf):
    return rounded(runlog.subtree_totals(tables.run_log(spark, sf)), "cost_usd")


def node_report(spark, sf):
    """The best scored node of every run and of every lever in it, with the levers that led there."""
    log = tables.run_log(spark, sf)
    best = log.filter("val_score IS NOT NULL").groupBy("run_id", "lever_id").agg(F.min_by("node_id", F.struct(-F.col("val_score"), "seq")).alias("node_id"))
    return runlog.node_reports(log, best).select(
        "run_id", "node_id", "depth", F.array_join("path", ">").alias("path"), F.array_join("lever_path", ">").alias("levers"), "val_score"
    )


def replay(spark, sf):
    rows = runlog.replay(tables.run_log(spark, sf))
    return rows.select("run_id", "seq", "position", "lever_id", F.try_element_at("params", F.lit("n")).alias("n"), "rationale")


def usage_cost(spark, sf):
    return rounded(runlog.usage_totals(tables.usage(spark, sf), PRICES), "cost_usd")


def k_band(spark, sf):
    """Each run's band around the mean score of each system, widened by the configurations the run tried."""
    means = scored(spark, sf).groupBy("system").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*[F.lit(s) for s in tables.SYSTEMS])).alias("system")
    runs = runlog.log_summary(tables.run_log(spark, sf)).select("run_id", "global_k", pairs)
    low, high = runlog.search_band(F.col("mean"), F.col("n"), F.col("global_k"))
    return runs.join(means, "system").select("run_id", "system", "n", "global_k", r6("mean").alias("mean"), r6(low).alias("low"), r6(high).alias("high"))


def band_progression(spark, sf):
    """Every system's band after every node of every run, as the configurations tried grow."""
    means = scored(spark, sf).groupBy("system").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    return rounded(runlog.band_progression(tables.run_log(spark, sf), means, tables.SYSTEMS), "mean", "low", "high")


def roundtrip_log(spark, sf):
    """Appends two halves of the log and reads the whole back."""
    path = scratch(spark, "log")
    log = tables.run_log(spark, sf)
    survey.append_log(log.filter(F.col("seq") % 2 == 0), path)
    survey.append_log(log.filter(F.col("seq") % 2 == 1), path)
    back = survey.read_log(spark, path)
    return back.select("run_id", "seq", "node_id", "parent_id", "lever_id", "dev_score", "val_score", "accepted", F.col("params")["n"].alias("n"))


QUERIES = {
    "nodes": nodes,
    "progression": progression,
    "running_cost": running_cost,
    "ladder_replay": ladder_replay,
    "config_lookup": config_lookup,
    "log_summary": log_summary,
    "tree": tree,
    "subtree_totals": subtree_totals,
    "node_report": node_report,
    "replay": replay,
    "usage_cost": usage_cost,
    "k_band": k_band,
    "band_progression": band_progression,
    "roundtrip_log": roundtrip_log,
}

_LOG = f"""ml AS (SELECT o_orderpriority AS run_id, date_trunc('month', o_orderdate) AS month, count(*) AS n, avg(o_totalprice) / 1000 AS price FROM orders GROUP BY ALL),
  sq AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY month) - 1 AS seq FROM ml),
  lg AS (SELECT run_id, seq, 'n' || lpad(CAST(seq AS VARCHAR), 4, '0') AS node_id, 'c' || seq % 29 AS config_hash,
    CASE WHEN seq % 13 <> 0 THEN 'n' || lpad(CAST((seq - 1) // 2 AS VARCHAR), 4, '0') END AS parent_id, 'lever_' || seq % 4 AS lever_id,
    'month ' || CAST(month AS DATE) AS rationale, {R('price')} AS dev_score, CASE WHEN seq % 3 <> 2 THEN {R('price + seq / 2')} END AS val_score,
    CASE WHEN seq % 5 = 0 THEN 0.0 ELSE n / 100 END AS cost_usd, seq % 2 = 0 AS accepted, CAST(n AS VARCHAR) AS n FROM sq)"""
LOG = f"WITH RECURSIVE {_LOG}"
_PATHS = """pt AS (SELECT run_id, node_id, node_id AS path, lever_id AS levers, [seq] AS places, 0 AS depth FROM lg WHERE parent_id IS NULL
  UNION ALL SELECT lg.run_id, lg.node_id, pt.path || '>' || lg.node_id, pt.levers || '>' || lg.lever_id, list_append(pt.places, lg.seq), pt.depth + 1
  FROM lg JOIN pt ON lg.run_id = pt.run_id AND lg.parent_id = pt.node_id)"""
_SCORED = "vs AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS step FROM lg WHERE val_score IS NOT NULL)"
_PRICE = "CASE model " + " ".join(f"WHEN '{m}' THEN prompt_tokens / 1e6 * {i} + completion_tokens / 1e6 * {o}" for m, (i, o) in PRICES.items()) + " END"

SQL = {
    "nodes": f"{LOG}, {_PATHS} SELECT run_id, node_id, depth, path, levers, val_score FROM pt JOIN (SELECT run_id, node_id, val_score FROM lg) USING (run_id, node_id)",
    "progression": f"""{LOG}, {_SCORED} SELECT run_id, step, node_id, lever_id, val_score, max(val_score) OVER (PARTITION BY run_id ORDER BY step) AS best_so_far,
      coalesce(val_score > max(val_score) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best FROM vs""",
    "running_cost": f"{LOG} SELECT run_id, node_id, {R('sum(cost_usd) OVER (PARTITION BY run_id ORDER BY seq)')} AS cum_cost_usd FROM lg",
    "ladder_replay": f"""{LOG}, {_SCORED}, gt AS (SELECT run_id, step, node_id, val_score AS best, true AS acc, 1 AS accepted_no FROM vs WHERE step = 1
        UNION ALL SELECT v.run_id, v.step, v.node_id, CASE WHEN v.val_score > g.best + {ETA} THEN v.val_score ELSE g.best END, v.val_score > g.best + {ETA},
          g.accepted_no + (v.val_score > g.best + {ETA})::INT FROM gt g JOIN vs v ON v.run_id = g.run_id AND v.step = g.step + 1)
      SELECT run_id, node_id, accepted_no FROM gt WHERE acc""",
    "config_lookup": f"""{LOG} SELECT run_id, config_hash, node_id, val_score FROM lg QUALIFY row_number() OVER (PARTITION BY run_id, config_hash ORDER BY val_score IS NULL, seq) = 1""",
    "log_summary": f"""{LOG} SELECT run_id, count(*) AS nodes, {R('sum(cost_usd)')} AS total_cost, count(DISTINCT config_hash) FILTER (WHERE val_score IS NOT NULL) AS global_k, max(val_score) AS best_val FROM lg GROUP BY run_id""",
    "tree": f"""{LOG}, {_PATHS} SELECT run_id, node_id, row_number() OVER (PARTITION BY run_id ORDER BY places) - 1 AS place,
        repeat('  ', depth) || CASE WHEN val_score IS NULL THEN '·' WHEN accepted THEN '✓' ELSE '✗' END || ' ' || lever_id ||
        ' (dev=' || printf('%.2f', dev_score) || CASE WHEN val_score IS NULL THEN '' ELSE ' val=' || printf('%.2f', val_score) END || ')' || CASE WHEN cost_usd <> 0 THEN ' $' || printf('%.2f', cost_usd) ELSE '' END AS line
      FROM pt JOIN (SELECT run_id, node_id, lever_id, dev_score, val_score, accepted, cost_usd FROM lg) USING (run_id, node_id)""",
    "subtree_totals": f"""{LOG}, {_PATHS}, bl AS (SELECT run_id, node_id AS top, node_id FROM lg
        UNION ALL SELECT bl.run_id, bl.top, lg.node_id FROM bl JOIN lg ON lg.run_id = bl.run_id AND lg.parent_id = bl.node_id)
      SELECT bl.run_id, top AS node_id, any_value(depth) AS depth, count(*) AS nodes, {R('sum(cost_usd)')} AS cost_usd
      FROM bl JOIN lg ON lg.run_id = bl.run_id AND lg.node_id = bl.node_id JOIN pt ON pt.run_id = bl.run_id AND pt.node_id = bl.top GROUP BY bl.run_id, top""",
    "node_report": f"""{LOG}, {_PATHS}, best AS (SELECT run_id, node_id, val_score FROM lg WHERE val_score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY run_id, lever_id ORDER BY val_score DESC, seq) = 1)
      SELECT run_id, node_id, depth, path, levers, val_score FROM best JOIN pt USING (run_id, node_id)""",
    "replay": f"{LOG} SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS position, lever_id, n, rationale FROM lg",
    "usage_cost": f"""WITH us AS (SELECT 'model_' || event_type AS model, 100 + user_id * 3 AS prompt_tokens, 20 + event_id % 50 AS completion_tokens,
        CASE WHEN event_id % 3 = 0 THEN value / 1000 END AS cost, event_id % 4 = 0 AS cached FROM events)
      SELECT model, count(*) FILTER (WHERE NOT cached) AS calls, count(*) FILTER (WHERE cached) AS cache_hits, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
        CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
        {R(f'sum(coalesce(cost, {_PRICE}, 0))')} AS cost_usd FROM us GROUP BY model""",
    "k_band": f"""{VIEWS}, {_LOG}, m AS (SELECT system, avg(score) AS mean, count(*) AS n FROM scored GROUP BY system),
      k AS (SELECT run_id, count(DISTINCT config_hash) FILTER (WHERE val_score IS NOT NULL) AS global_k FROM lg GROUP BY run_id),
      h AS (SELECT run_id, system, m.n, global_k, mean, pow(ln(global_k * m.n) / m.n, 1.0 / 3) * 100 AS half FROM k, m)
      SELECT run_id, system, n, global_k, {R('mean')} AS mean, {R('mean - half')} AS low, {R('mean + half')} AS high FROM h""",
    "band_progression": f"""{VIEWS}, {_LOG}, m AS (SELECT system, avg(score) AS mean, count(*) AS n FROM scored GROUP BY system),
      fo AS (SELECT *, val_score IS NOT NULL AND row_number() OVER (PARTITION BY run_id, config_hash ORDER BY val_score IS NULL, seq) = 1 AS new FROM lg),
      k AS (SELECT run_id, seq, node_id, count(*) FILTER (WHERE new) OVER (PARTITION BY run_id ORDER BY seq) AS k FROM fo),
      h AS (SELECT run_id, seq, node_id, system, k, m.n, mean, pow(ln(greatest(k, 1) * m.n) / m.n, 1.0 / 3) * 100 AS half FROM k, m)
      SELECT run_id, seq, node_id, system, k, n, {R('mean')} AS mean, {R('mean - half')} AS low, {R('mean + half')} AS high FROM h""",
    "roundtrip_log": f"{LOG} SELECT run_id, seq, node_id, parent_id, lever_id, dev_score, val_score, accepted, n FROM lg",
}
