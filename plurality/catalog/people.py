"""Personas: matching, panels, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.ingest import PERSONAS
from plurality.operators import personas
from plurality.sources import tables


def persona_matchable(spark, sf):
    rows = tables.persona_segments(spark, sf)
    return rows.select("segment_key", personas.is_matchable(F.col("segment")).alias("matchable"))


def persona_match(spark, sf):
    return personas.pool_sizes(tables.persona_segments(spark, sf), tables.personas(spark, sf))


def panel(spark, sf):
    out = personas.panels(tables.persona_segments(spark, sf), tables.personas(spark, sf), k=8)
    return out.select("segment_key", "uuid", "draw", "pool")


def persona_axes(spark, sf):
    values = personas.axis_values()
    return personas.adults(tables.personas(spark, sf)).select("uuid", *[v.alias(n.lower()) for n, v in values.items()])


def render_persona(spark, sf):
    rows = tables.personas(spark, sf)
    return rows.select(
        "uuid", personas.render_persona("summary").alias("summary"), personas.render_persona("rich").alias("rich")
    )


QUERIES = {
    "persona_axes": persona_axes,
    "persona_matchable": persona_matchable,
    "persona_match": persona_match,
    "panel": panel,
    "render_persona": render_persona,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in pairs) + " END"


def _arr(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


_AXES = f"""pa AS (SELECT *, CASE WHEN age BETWEEN 18 AND 29 THEN '18-29' WHEN age BETWEEN 30 AND 49 THEN '30-49' WHEN age BETWEEN 50 AND 64 THEN '50-64' WHEN age >= 65 THEN '65+' END AS p_age,
  {_case('state', [(s, r) for r, states in personas.REGION_STATES.items() for s in states])} AS p_cregion,
  {_case('education_level', [(c, e) for e, codes in personas.EDUCATION_CODES.items() for c in codes])} AS p_education,
  {_case('marital_status', [(c, m) for m, c in personas.MARITAL_CODES.items()])} AS p_marital, lower(sex) AS p_sex FROM personas WHERE age >= 18)"""

_SEGMENTS = f"""sg AS (SELECT *, CASE WHEN key0 = '' THEN '<pop>' ELSE key0 END AS segment_key FROM (
    SELECT DISTINCT a, s, c, m, r, concat_ws('|', 'AGE=' || a, 'CREGION=' || c, 'MARITAL=' || m, 'RACE=' || r, 'SEX=' || s) AS key0 FROM (
      SELECT CASE WHEN o_orderkey % 2 = 0 THEN {_arr(tables.AGES)}[o_custkey % 5 + 1] END AS a, CASE WHEN o_orderkey % 3 = 0 THEN {_arr(tables.SEXES)}[o_custkey % 3 + 1] END AS s,
        CASE WHEN o_orderkey % 5 = 0 THEN {_arr(tables.REGIONS)}[o_custkey % 4 + 1] END AS c, CASE WHEN o_orderkey % 7 = 0 THEN {_arr(tables.MARITAL_ANSWERS)}[o_custkey % 5 + 1] END AS m,
        CASE WHEN o_orderkey % 11 = 0 THEN 'any' END AS r FROM orders))),
  ok AS (SELECT *, coalesce(a, '') <> '17-' AND coalesce(s, '') <> 'other' AND coalesce(m, '') <> 'living with a partner' AND r IS NULL AS matchable FROM sg)"""

_FITS = f"""WITH {PERSONAS}, {_AXES}, {_SEGMENTS}, ft AS (SELECT segment_key, uuid, count(*) OVER (PARTITION BY segment_key) AS pool FROM ok, pa
  WHERE matchable AND (a IS NULL OR a = p_age) AND (c IS NULL OR c = p_cregion) AND (m IS NULL OR m = p_marital) AND (s IS NULL OR s = p_sex))"""

_JOB = "replace(occupation, '_', ' ')"
SQL = {
    "persona_axes": f"WITH {PERSONAS}, {_AXES} SELECT uuid, p_age AS age, p_cregion AS cregion, p_education AS education, p_marital AS marital, p_sex AS sex FROM pa",
    "persona_matchable": f"WITH {_SEGMENTS} SELECT segment_key, matchable FROM ok",
    "persona_match": f"{_FITS} SELECT segment_key, any_value(pool) AS pool FROM ft GROUP BY segment_key",
    "panel": f"""{_FITS}, rk AS (SELECT *, row_number() OVER (PARTITION BY segment_key ORDER BY sha256('0::' || segment_key || '::' || uuid)) AS draw FROM ft WHERE pool >= 10)
      SELECT segment_key, uuid, draw, pool FROM rk WHERE draw <= 8""",
    "render_persona": f"""WITH {PERSONAS} SELECT uuid, persona AS summary, concat_ws(chr(10), 'A ' || age || '-year-old ' || lower(sex) || ', ' ||
        {_case('marital_status', personas.MARITAL_PROSE.items())} || ', with ' || {_case('education_level', personas.EDUCATION_PROSE.items())} ||
        CASE WHEN {_JOB} IN ({', '.join(_q(j) for j in personas.NO_JOB)}) THEN ', ' || {_JOB} ELSE ', working as a ' || {_JOB} END || ', living in ' || city || ', ' || state || '.',
        persona, 'Work: ' || professional_persona, 'Interests: ' || hobbies_and_interests) AS rich FROM personas""",
}
