"""Shared pieces of the named queries: rounding, the scored table, and the SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plurality.functions.rounding import r6
from plurality.operators.evaluate import evaluate
from plurality.sources import tables


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(tables.cells(spark, sf_dir), tables.predictions(spark, sf_dir))


def R(expression: str) -> str:
    """SQL twin of ``r6``."""
    return f"round({expression} + 1e-9, 6)"


VIEWS = """
WITH RECURSIVE people AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, r_name, n_name, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
resp AS (
  SELECT r_name AS dataset, 'status' AS question, o_orderstatus AS opt, n_name AS g1, c_mktsegment AS g2, o_orderkey % 2 AS half FROM people
  UNION ALL SELECT r_name, 'priority', o_orderpriority, n_name, c_mktsegment, o_orderkey % 2 FROM people
  UNION ALL SELECT r_name, 'returnflag', l_returnflag, n_name, c_mktsegment, o_orderkey % 2 FROM lineitem JOIN people ON l_orderkey = o_orderkey
  UNION ALL SELECT 'suppliers', 'returned to supplier ' || l_suppkey, l_returnflag, l_linestatus, CAST(l_linenumber % 2 AS VARCHAR), l_orderkey % 2 FROM lineitem
  UNION ALL SELECT lang, 'quality', CAST(quality AS VARCHAR), source, CAST(toxic AS VARCHAR), d.doc_id % 2 FROM documents d JOIN labels b ON d.doc_id = b.doc_id
  UNION ALL SELECT 'documents', 'lang', lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END,
    CAST(doc_id % 4 AS VARCHAR), doc_id % 2 FROM documents
  UNION ALL SELECT 'events', 'event_type', event_type, CAST(user_id % 5 AS VARCHAR), CAST(hour(ts) // 6 AS VARCHAR), event_id % 2 FROM events
  UNION ALL SELECT 'conversations', 'role', role, CAST(least(turn, 4) AS VARCHAR), CAST(conv_id % 5 AS VARCHAR), conv_id % 2 FROM conversations),
finest AS (SELECT dataset, question, opt, g1, g2, count(*) AS n, count(*) FILTER (WHERE half = 0) AS n0 FROM resp GROUP BY ALL),
rolled AS (
  SELECT dataset, question, opt, g1, g2, sum(n) AS n, sum(n0) AS n0 FROM finest
  GROUP BY GROUPING SETS ((dataset, question, opt), (dataset, question, opt, g1), (dataset, question, opt, g2), (dataset, question, opt, g1, g2))),
axis AS (SELECT dataset, question, opt, count(*) OVER (PARTITION BY dataset, question) AS k,
  row_number() OVER (PARTITION BY dataset, question ORDER BY opt) AS pos FROM (SELECT DISTINCT dataset, question, opt FROM finest)),
cell AS (
  SELECT *, dataset || '|' || question || '|' || segkey AS record_id FROM (
    SELECT dataset, question, g1, g2, CAST(sum(n) AS DOUBLE) AS size, CAST(sum(n0) AS DOUBLE) AS size0,
      CASE WHEN g1 IS NULL AND g2 IS NULL THEN 'pop' ELSE 'grouped' END AS split,
      (g1 IS NOT NULL)::INT + (g2 IS NOT NULL)::INT AS nv,
      CASE WHEN g1 IS NULL AND g2 IS NULL THEN '<pop>' ELSE concat_ws('|', 'g1=' || g1, 'g2=' || g2) END AS segkey
    FROM rolled GROUP BY dataset, question, g1, g2)),
cl AS (
  SELECT c.*, a.opt, a.k, a.pos, coalesce(r.n, 0) / c.size AS p,
    CASE WHEN c.size0 > 0 THEN coalesce(r.n0, 0) / c.size0 ELSE 1.0 / a.k END AS h
  FROM cell c JOIN axis a ON c.dataset = a.dataset AND c.question = a.question
  LEFT JOIN rolled r ON r.dataset = c.dataset AND r.question = c.question AND r.opt = a.opt
    AND r.g1 IS NOT DISTINCT FROM c.g1 AND r.g2 IS NOT DISTINCT FROM c.g2),
popl AS (SELECT dataset, question, opt, p AS m, p * p / sum(p * p) OVER (PARTITION BY dataset, question) AS m2 FROM cl WHERE split = 'pop'),
x AS (
  SELECT record_id, cl.dataset, split, cl.question, segkey, g1, g2, nv, size, cl.opt, k, pos, p,
    unnest(['uniform', 'marginal', 'half', 'blend', 'peaked']) AS system,
    unnest([1.0 / k, m, h, (m + h) / 2, m2]) AS q
  FROM cl JOIN popl ON cl.dataset = popl.dataset AND cl.question = popl.question AND cl.opt = popl.opt),
truth AS (
  SELECT record_id, any_value(dataset) AS dataset, any_value(split) AS split, any_value(question) AS question, any_value(segkey) AS segkey,
    any_value(g1) AS g1, any_value(g2) AS g2, any_value(nv) AS nv, any_value(size) AS size, any_value(k) AS k,
    sum(abs(p - 1.0 / k)) / 2 AS tvd_u,
    CASE WHEN count(*) FILTER (WHERE p > 0) <= 1 THEN 0.0 ELSE -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(any_value(k)) END AS te
  FROM cl GROUP BY record_id),
norm AS (SELECT split, dataset, avg(tvd_u) AS z FROM truth GROUP BY split, dataset),
scored AS (
  SELECT s.*, t.* EXCLUDE (record_id), n.z, CASE WHEN n.z <= 0 THEN 0.0 ELSE 100.0 * (1.0 - s.tvd / n.z) END AS score
  FROM (SELECT record_id, system, sum(abs(p - q)) / 2 AS tvd,
      CASE WHEN count(*) FILTER (WHERE q > 0) <= 1 THEN 0.0 ELSE -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(any_value(k)) END AS pe
    FROM x GROUP BY record_id, system) s
  JOIN truth t ON s.record_id = t.record_id JOIN norm n ON n.split = t.split AND n.dataset = t.dataset)
"""


def replicates(rows: str, groups: str, value: str, n_boot: int, seed: int = 0, name: str = "boot") -> str:
    """SQL views ``<name>_w`` and ``<name>`` (groups, replicate, mean) for the hash-weighted bootstrap."""
    from plurality.operators.bootstrap import MIX_A, MIX_B, REPLICATE_STEP, poisson_cuts

    mask = 4294967295
    weight = " + ".join(f"(u >= {c})::INT" for c in poisson_cuts())
    comma = f"{groups}, " if groups else ""
    return f"""
{name}_h AS (SELECT DISTINCT record_id, ('0x' || substr(sha256('{seed}::' || record_id), 1, 8))::UBIGINT AS h FROM {rows}),
{name}_1 AS (SELECT record_id, b, xor(h, (b::UBIGINT * {REPLICATE_STEP}::UBIGINT) & {mask}::UBIGINT) AS v FROM {name}_h, range({n_boot}) t(b)),
{name}_2 AS (SELECT record_id, b, (xor(v, v >> 16) * {MIX_A}::UBIGINT) & {mask}::UBIGINT AS v FROM {name}_1),
{name}_3 AS (SELECT record_id, b, (xor(v, v >> 13) * {MIX_B}::UBIGINT) & {mask}::UBIGINT AS v FROM {name}_2),
{name}_4 AS (SELECT record_id, b, xor(v, v >> 16) & 65535::UBIGINT AS u FROM {name}_3),
{name}_w AS (SELECT record_id, b, {weight} AS w FROM {name}_4),
{name} AS (SELECT {comma}b, sum(w * {value}) / nullif(sum(w), 0) AS mean FROM {rows} JOIN {name}_w USING (record_id) GROUP BY {comma}b)
"""
