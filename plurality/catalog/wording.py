"""Stems, phrases, kinds, option blocks, item corpora, drawn descriptors and rendered requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.functions import describe, keys
from plurality.operators import requests
from plurality.sources import tables


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stem(spark, sf):
    return tables.text_cells(spark, sf).select("record_id", describe.question_stem(F.col("question")).alias("stem"))


def year_place(spark, sf):
    rows = tables.text_cells(spark, sf)
    return rows.select(
        "record_id",
        describe.year_of(F.col("group_prompt")).alias("year"),
        describe.place_of(F.col("segment"), F.col("group_prompt")).alias("place"),
    )


def verbalize(spark, sf):
    rows = tables.text_cells(spark, sf)
    place = describe.place_of(F.col("segment"), F.col("group_prompt"))
    return rows.select("record_id", describe.segment_phrase(F.col("segment"), place).alias("phrase"))


def task_kind(spark, sf):
    rows = tables.text_cells(spark, sf)
    return rows.select("record_id", describe.task_kind(F.col("question"), F.col("group_prompt"), F.col("options")).alias("kind"))


def snap_label(spark, sf):
    """Noisy labels, one per distinct stem: a known kind in capitals, or nothing usable."""
    cells = tables.text_cells(spark, sf)
    stems = cells.select(describe.strip(F.col("question")).alias("stem")).distinct()
    h = keys.hash32(F.col("stem")) % 3
    noisy = F.when(h == 0, F.lit("Kind: KNOWLEDGE!")).when(h == 1, F.lit("moral_dilemma or other")).otherwise(F.lit("no idea"))
    return requests.classify_stems(cells, stems.withColumn("text", noisy))


def options_block(spark, sf):
    """Every part as a free question with its brand, type and size as options."""
    parts = tables.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit(" "), "p_name", F.lit("? ")).alias("question"),
        F.concat_ws("; ", "p_brand", "p_type", F.lit(""), F.col("p_size").cast("string")).alias("options"),
    )
    cells = requests.ask_cells(parts)
    return cells.select("record_id", "question", F.array_join("options", ",").alias("labels"), F.get(F.map_values("truth"), 0).alias("share"))


def item_corpus(spark, sf):
    return requests.item_corpus(tables.text_cells(spark, sf))


def siblings(spark, sf):
    rows = requests.siblings(tables.text_cells(spark, sf), k=6)
    return rows.select("record_id", F.array_join("siblings", "\n").alias("siblings"))


# Clauses of drawn individuals, taken from the tables: axis, table, text, column, concepts that pin the axis.
POOLS = (
    ("outlook", "region", "follows the news from ", "r_name", ()),
    ("age", "customer", "work in ", "c_mktsegment", ("age",)),
    ("education", "part", "buy from ", "p_brand", ("education",)),
    ("locality", "nation", "live near ", "n_name", ("locality", "city size", "region")),
    ("income", "orders", "order at ", "o_orderpriority", ("income", "income strain", "social standing")),
)
AXES = tuple(p[0] for p in POOLS)


def _pools(spark, sf):
    out = None
    for axis, name, words, column, pins in POOLS:
        clauses = tables.table(spark, sf, name).select(F.concat(F.lit(words), column).alias("clause")).distinct()
        part = clauses.select(F.lit(axis).alias("axis"), "clause", F.array(*[F.lit(p) for p in pins]).cast("array<string>").alias("pinned_by"))
        out = part if out is None else out.unionByName(part)
    return out


def _dispositions(spark, sf):
    return tables.table(spark, sf, "part").select(F.concat(F.lit("prefers "), "p_type").alias("clause")).distinct()


def draw_descriptors(spark, sf):
    rows = requests.draw_individuals(tables.text_cells(spark, sf), _pools(spark, sf), AXES, 3)
    return rows.select("record_id", "draw", "descriptor")


def draw_dispositions(spark, sf):
    rows = requests.draw_dispositions(tables.text_cells(spark, sf), _dispositions(spark, sf), 4, seed=2)
    return rows.select("record_id", "draw", "descriptor")


BRIEFS = {"src1": "a long questionnaire", "src7": "a quiz"}
GROUP_STYLES = tuple(s for s in requests.STYLES if s not in ("individual", "voter"))


def _contents(rows, *keep):
    last = F.element_at("messages", -1)
    return rows.select("record_id", *keep, "style", F.size("messages").alias("n"), F.sha2(last["content"], 256).alias("user_hash"))


def render_request(spark, sf):
    cells = requests.siblings(tables.text_cells(spark, sf), k=2)
    return _contents(requests.render_requests(cells, GROUP_STYLES, BRIEFS))


def render_draws(spark, sf):
    cells = requests.draw_dispositions(tables.text_cells(spark, sf), _dispositions(spark, sf), 2)
    return _contents(requests.render_requests(cells, ("voter", "individual")), "draw")


QUERIES = {
    "stem": stem,
    "year_place": year_place,
    "verbalize": verbalize,
    "task_kind": task_kind,
    "snap_label": snap_label,
    "options_block": options_block,
    "item_corpus": item_corpus,
    "siblings": siblings,
    "draw_descriptors": draw_descriptors,
    "draw_dispositions": draw_dispositions,
    "render_request": render_request,
    "render_draws": render_draws,
}


def _arr(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


_SPACE = r"[\s\pZ]+"
_STRIP = f"regexp_replace(regexp_replace({{t}}, '^{_SPACE}', ''), '{_SPACE}$', '')"
TEXT = f"""WITH tc AS (SELECT 'doc' || doc_id AS record_id, doc_id AS d, source AS dataset, lang,
    {_arr(tables.OPENINGS)}[doc_id % {len(tables.OPENINGS)} + 1] || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Options:' || chr(10) || '(A): yes' || chr(10) || '(B): no' ELSE '' END AS question,
    {_arr(tables.PROMPTS)}[doc_id % {len(tables.PROMPTS)} + 1] AS prompt, CASE WHEN doc_id % 4 = 0 THEN 'agree disagree' ELSE 'a b' END AS ot FROM documents),
  tq AS (SELECT *, {_STRIP.format(t='question')} AS item FROM tc)"""

_STEM = f"""(CASE WHEN contains({{t}}, 'Options:') THEN split_part({{t}}, 'Options:', 1) WHEN contains({{t}}, 'Options' || chr(10)) THEN split_part({{t}}, 'Options' || chr(10), 1) ELSE {{t}} END)"""
_LINE = f"trim(regexp_replace({_STEM}, '{_SPACE}', ' ', 'g'))"


def _cut(t: str) -> str:
    line = _LINE.format(t=t)
    return f"CASE WHEN length({line}) > 220 THEN left({line}, 220) || '…' ELSE {line} END"


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


_KIND = f"""CASE WHEN {_has('lower(question)', describe.GAMBLE_WORDS)} OR (contains(question, '$') AND regexp_matches(lower(question), '\\d+(\\.\\d+)?%|chance')) THEN 'risky_choice'
  WHEN {_has('lower(question)', describe.MORAL_WORDS)} THEN 'moral_dilemma'
  WHEN contains(lower(question), 'indicate your level of agreement') OR contains(lower(prompt), 'openpsychometrics') THEN 'personality_scale'
  WHEN contains(lower(question), 'number game') OR contains(lower(prompt), 'wisdom of crowds') OR contains(lower(question), 'general knowledge') THEN 'knowledge'
  WHEN {_has('ot', describe.ORDINAL_WORDS)} OR {_has('lower(prompt)', describe.SURVEY_WORDS)} THEN 'opinion_survey' ELSE 'other' END"""

_PLACE = "CASE WHEN d % 4 = 1 THEN 'Finland' WHEN d % 5 = 1 THEN 'Kenya' END"
_PHRASE = """concat_ws(', ', CASE WHEN d % 4 = 1 THEN 'from Finland' WHEN d % 5 = 1 THEN 'from Kenya' END,
  CASE d % 4 WHEN 1 THEN 'in the 30-49 age group' WHEN 2 THEN 'whose religiosity is 7 on a 0-10 scale, whose shoe size is big' WHEN 3 THEN 'who are female, who live in ' || lang END)"""
_YEAR = "CASE d % 5 WHEN 0 THEN '2012' WHEN 1 THEN '1999' END"

_SIBS = """co AS (SELECT DISTINCT dataset, item FROM tq),
  fi AS (SELECT dataset, item FROM co QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY item) <= {k1}),
  sb AS (SELECT t.record_id, f.item, row_number() OVER (PARTITION BY t.record_id ORDER BY f.item) AS rn FROM tq t JOIN fi f ON f.dataset = t.dataset AND f.item <> t.item),
  sl AS (SELECT record_id, string_agg({prefix} || ({cut}), chr(10) ORDER BY rn) AS sibs FROM sb WHERE rn <= {k} GROUP BY record_id)"""


def _u(seed: int, axis: str) -> str:
    return f"('0x' || substr(sha256('{seed}::' || draw || '::{axis}'), 1, 16))::UBIGINT / 18446744073709551616.0"


def _from(axis: str, seed: int, free: str = "true") -> str:
    return f"CASE WHEN {free} THEN {axis}[least(len({axis}) - 1, CAST(floor({_u(seed, axis)} * len({axis})) AS INT)) + 1] END"


_POOLS = "pl AS (SELECT " + ", ".join(
    f"(SELECT list(DISTINCT {_q(words)} || {column} ORDER BY {_q(words)} || {column}) FROM {name}) AS {axis}" for axis, name, words, column, _ in POOLS
) + ")"

_DISP = """dp AS (SELECT list(DISTINCT 'prefers ' || p_type ORDER BY 'prefers ' || p_type) AS ds FROM part),
  {p} AS (SELECT *, least(len(ds) - 1, CAST(floor({u1} * len(ds)) AS INT)) AS a, least(len(ds) - 2, CAST(floor({u2} * (len(ds) - 1)) AS INT)) AS b0 FROM tq, dp, range({n}) r(draw)),
  {p}d AS (SELECT *, ds[a + 1] || ', and ' || ds[CASE WHEN b0 >= a THEN b0 + 2 ELSE b0 + 1 END] AS descriptor FROM {p})"""


def _styles(names) -> str:
    return "(VALUES " + ", ".join(f"({_q(n)}, {_q(requests.STYLES[n][0])}, {_q(requests.STYLES[n][1])})" for n in names) + ") st(style, sys, usr)"


def _fill(draw: str, brief: str, items: str) -> str:
    slots = {
        "who": f"CASE WHEN {_PHRASE} = '' THEN 'people' ELSE 'people ' || {_PHRASE} END",
        "year": f"coalesce(' as of ' || {_YEAR}, '')",
        "labels": "CASE WHEN d % 4 = 0 THEN 'Agree, Disagree' ELSE 'A, B' END",
        "draw": draw,
        "brief": brief,
        "items": items,
        "persona": "CASE WHEN prompt <> '' THEN prompt || chr(10) || chr(10) ELSE '' END",
        "question": "item",
    }
    text = "usr"
    for name, value in slots.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


_BRIEF = "coalesce('They are taking part in ' || CASE dataset " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in BRIEFS.items()) + " END || '.' || chr(10) || chr(10), '')"

SQL = {
    "stem": f"{TEXT} SELECT record_id, {_cut('question')} AS stem FROM tc",
    "year_place": f"{TEXT} SELECT record_id, {_YEAR} AS year, {_PLACE} AS place FROM tc",
    "verbalize": f"{TEXT} SELECT record_id, {_PHRASE} AS phrase FROM tc",
    "task_kind": f"{TEXT} SELECT record_id, {_KIND} AS kind FROM tc",
    "snap_label": f"""{TEXT} SELECT record_id, CASE ('0x' || substr(sha256(item), 1, 8))::UBIGINT % 3 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'moral_dilemma' ELSE {_KIND} END AS kind FROM tq""",
    "options_block": """SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_name || '?' || chr(10) || chr(10) || 'Options:' || chr(10) || '(A): ' || p_brand || chr(10) || '(B): ' || p_type || chr(10) || '(C): ' || p_size AS question,
      'A,B,C' AS labels, 1.0::DOUBLE / 3 AS share FROM part""",
    "item_corpus": f"{TEXT} SELECT DISTINCT dataset, item FROM tq",
    "siblings": f"{TEXT}, {_SIBS.format(k1=7, k=6, prefix=_q(''), cut=_cut('item'))} SELECT record_id, coalesce(sibs, '') AS siblings FROM tq LEFT JOIN sl USING (record_id)",
    "draw_descriptors": f"""{TEXT}, {_POOLS}, dr AS (SELECT *, {_from('outlook', 0)} AS view, concat_ws(', ', {_from('age', 0, 'd % 4 <> 1')},
        {_from('education', 0)}, {_from('locality', 0, 'd % 4 <> 3')}, {_from('income', 0)}) AS rest FROM tq, pl, range(3) r(draw))
      SELECT record_id, draw, CASE WHEN rest = '' THEN view ELSE view || '; they ' || rest END AS descriptor FROM dr""",
    "draw_dispositions": f"{TEXT}, {_DISP.format(p='dd', n=4, u1=_u(2, 'first'), u2=_u(2, 'second'))} SELECT record_id, draw, descriptor FROM ddd",
    "render_request": f"""{TEXT}, {_SIBS.format(k1=3, k=2, prefix=_q('  - '), cut=_cut('item'))}
      SELECT tq.record_id, style, CASE WHEN sys = '' THEN 1 ELSE 2 END AS n,
        sha256({_fill("'is an ordinary member of the group'", _BRIEF, "coalesce('Other items of the same questionnaire:' || chr(10) || sibs || chr(10) || chr(10), '')")}) AS user_hash
      FROM tq LEFT JOIN sl ON sl.record_id = tq.record_id, {_styles(GROUP_STYLES)}""",
    "render_draws": f"""{TEXT}, {_DISP.format(p='dd', n=2, u1=_u(0, 'first'), u2=_u(0, 'second'))}
      SELECT record_id, draw, style, CASE WHEN sys = '' THEN 1 ELSE 2 END AS n, sha256({_fill('descriptor', "''", "''")}) AS user_hash FROM ddd, {_styles(('voter', 'individual'))}""",
}
