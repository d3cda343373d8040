"""Request tables: item corpora, siblings, drawn descriptors, and rendered messages.

A style is a row of data: a system text and a user text with named slots.  Slots are
``{who}``, ``{year}``, ``{question}``, ``{labels}``, ``{persona}``, ``{draw}``, ``{brief}``
and ``{items}``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import describe, dist, keys
from plurality.plans.ranking import first_distinct
from plurality.plans.skew import attach

ASK_SHARES = "Reply only with a JSON object that gives each of [{labels}] its probability; they must add up to 1."
ASK_CHOICE = 'Reply only with a JSON object of the form {"choice": "<one of {labels}>"}.'
_GROUP = "Think of many {who}{year}.\n\n{question}\n\n"

STYLES: dict[str, tuple[str, str]] = {
    "faithful": ("", "{persona}{question}\n\nEstimate the answers of a large sample of such people. " + ASK_SHARES),
    "representative_sample": (
        "You are a survey methodologist who reasons about whole groups, never one typical member.",
        _GROUP + "Estimate how the whole group splits. " + ASK_SHARES,
    ),
    "persona_embodiment": (
        "You speak for one population and know how its members differ.",
        "You represent {who}{year}.\n\n{question}\n\nHow do your people answer? " + ASK_SHARES,
    ),
    "anti_flattening": (
        "You estimate answer distributions and resist both stereotypes and false consensus.",
        _GROUP + "Do not flatten real differences. " + ASK_SHARES,
    ),
    "contextualized": (
        "You know the history and institutions behind public opinion.",
        _GROUP + "Consider the circumstances of the place and time first. " + ASK_SHARES,
    ),
    "calibrated_commitment": (
        "You forecast group answers and match your spread to how divided the group is.",
        _GROUP + "Commit where the group agrees and spread out where it is divided. " + ASK_SHARES,
    ),
    "diversity_elicitation": (
        "You list the camps inside a group before you judge their size.",
        _GROUP + "Name the different viewpoints to yourself, then weigh them. " + ASK_SHARES,
    ),
    "outside_view": (
        "You start from base rates of similar questions.",
        _GROUP + "Start from how such questions usually split, then adjust. " + ASK_SHARES,
    ),
    "entropy_first": (
        "You decide how divided a group is before you decide which side leads.",
        _GROUP + "First settle how spread the answers are, then where they lie. " + ASK_SHARES,
    ),
    "superforecaster": (
        "You are a careful forecaster who is scored on calibration.",
        _GROUP + "Weigh reasons for and against each option before you answer. " + ASK_SHARES,
    ),
    "individual": (
        "You answer as one person.",
        "Be one of {who}{year} who {draw}.\n\n{question}\n\nHow likely is this person to give each answer? " + ASK_SHARES,
    ),
    "task_context": (
        "You forecast group answers and match your spread to how divided the group is.",
        "Think of many {who}{year}.\n\n{brief}{items}{question}\n\nCommit where the group agrees and spread out where it is divided. "
        + ASK_SHARES,
    ),
    "voter": (
        "You are one member of the public and decide as that person would.",
        "Be one of {who}{year} who {draw}.\n\n{question}\n\nChoose the one option this person takes. " + ASK_CHOICE,
    ),
    "persona_voter": (
        "You are the person described and decide as that person would.",
        "{persona}{question}\n\nChoose the one option you take. " + ASK_CHOICE,
    ),
    "persona_dist": (
        "You are the person described.",
        "{persona}{question}\n\nHow likely are you to give each answer? " + ASK_SHARES,
    ),
}

def item_corpus(cells: DataFrame) -> DataFrame:
    """Distinct question texts per dataset."""
    return cells.select("dataset", describe.strip(F.col("question")).alias("item")).distinct()


def siblings(cells: DataFrame, k: int = 6) -> DataFrame:
    """First ``k`` other items of the dataset by text, as stems, for every cell.

    Only the first k + 1 items of a dataset can ever be needed.  They are shortened to stems once,
    and travel to the cells as (hash of the whole item, stem).
    """
    items = cells.select("record_id", "dataset", describe.strip(F.col("question")).alias("item"))
    first = first_distinct(items, ["dataset"], "item", k + 1, ["record_id"])
    entry = F.struct("item", F.sha2("item", 256).alias("h"), describe.question_stem(F.col("item")).alias("stem"))
    in_order = F.array_sort(F.collect_list(entry))
    packed = first.groupBy("dataset").agg(
        F.transform(in_order, lambda e: F.struct(e["h"].alias("h"), e["stem"].alias("stem"))).alias("_items")
    )
    rows = attach(cells, packed, ["dataset"], ["record_id"])
    own = F.sha2(describe.strip(F.col("question")), 256)
    others = dist.let(own, lambda o: F.slice(F.filter(F.col("_items"), lambda e: e["h"] != o), 1, k))
    return rows.withColumn("siblings", F.transform(others, lambda e: e["stem"])).drop("_items")


def _place(u: Column, size: Column) -> Column:
    """0-based position in a list of ``size`` entries for a uniform value."""
    return F.least(size - 1, F.floor(u * size)).cast("int")


def draw_individuals(cells: DataFrame, pools: DataFrame, axes: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` seeded individuals per cell: a clause of the first axis, and of the other axes that the segment leaves open.

    ``pools`` holds (axis, clause, pinned_by): an axis is left out where the segment has one of its ``pinned_by``
    concepts.  The draws of all cells are the same, so they are made once per draw and joined by its number.
    """
    order = F.array_position(F.array(*[F.lit(a) for a in axes]), F.col("axis"))
    packed = pools.filter(order > 0).groupBy("axis").agg(F.array_sort(F.collect_set("clause")).alias("clauses"), F.max("pinned_by").alias("pinned_by"))
    draws = packed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    chosen = F.get("clauses", _place(keys.hash_unit(seed, F.col("draw").cast("string"), F.col("axis")), F.size("clauses")))
    per_draw = draws.groupBy("draw").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), chosen.alias("clause"), "pinned_by"))).alias("_drawn"))
    rows = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = attach(rows, per_draw, ["draw"], ["record_id"])
    pinned = F.transform(F.map_keys("segment"), lambda k: describe.concept(k))
    first = F.get(F.filter("_drawn", lambda c: c["order"] == 1), 0)["clause"]
    rest = F.filter("_drawn", lambda c: (c["order"] > 1) & ~F.coalesce(F.arrays_overlap(pinned, c["pinned_by"]), F.lit(False)))
    text = F.concat_ws("; they ", first, F.nullif(F.array_join(F.transform(rest, lambda c: c["clause"]), ", "), F.lit("")))
    return rows.withColumn("descriptor", text).drop("_drawn")


def draw_dispositions(cells: DataFrame, pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` seeded voters per cell, each with two different clauses of ``pool`` (clause)."""
    packed = pool.groupBy(F.lit(0).alias("one")).agg(F.array_sort(F.collect_set("clause")).alias("clauses"))
    size = F.size("clauses")
    u = lambda axis: keys.hash_unit(seed, F.col("draw").cast("string"), F.lit(axis))
    a, b = _place(u("first"), size), _place(u("second"), size - 1)
    per_draw = packed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "draw", F.concat_ws(", and ", F.get("clauses", a), F.get("clauses", F.when(b >= a, b + 1).otherwise(b))).alias("descriptor")
    )
    rows = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return attach(rows, per_draw, ["draw"], ["record_id"])


def _slot(text: Column, slots: Mapping[str, Column]) -> Column:
    for name, value in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def render_requests(
    cells: DataFrame, styles: Sequence[str] | None = None, briefs: Mapping[str, str] | None = None
) -> DataFrame:
    """(record_id, style, messages, key): one request per cell, style and, where present, draw.

    ``cells`` may carry ``descriptor`` (drawn individual), ``persona`` (text) and ``siblings``.
    The question text is filled in last, so a slot name inside it stays as it is.
    """
    have = set(cells.columns)
    names = list(STYLES if styles is None else styles)
    table = F.array(
        *[F.struct(F.lit(n).alias("style"), F.lit(STYLES[n][0]).alias("system"), F.lit(STYLES[n][1]).alias("user")) for n in names]
    )
    phrase = describe.segment_phrase(F.col("segment"), describe.place_of(F.col("segment"), F.col("group_prompt")))
    year = describe.year_of(F.col("group_prompt"))
    prompt = F.col("persona") if "persona" in have else describe.strip(F.coalesce("group_prompt", F.lit("")))
    rows = cells.withColumns(
        {
            "_who": F.when(phrase == "", F.lit("people")).otherwise(F.concat(F.lit("people "), phrase)),
            "_year": F.when(year.isNotNull(), F.concat(F.lit(" as of "), year)),
            "_persona": F.when(prompt != "", F.concat(prompt, F.lit("\n\n"))),
            "_question": describe.strip(F.col("question")),
            "_labels": F.array_join("options", ", "),
        }
    )
    items = brief = F.lit("")
    if "siblings" in have:
        bullets = F.array_join(F.transform("siblings", lambda s: F.concat(F.lit("  - "), s)), "\n")
        items = F.when(
            F.size("siblings") > 0, F.concat(F.lit("Other items of the same questionnaire:\n"), bullets, F.lit("\n\n"))
        )
    if briefs:
        known = F.try_element_at(F.create_map(*[F.lit(x) for p in briefs.items() for x in p]), F.col("dataset"))
        brief = F.when(known.isNotNull(), F.concat(F.lit("They are taking part in "), known, F.lit(".\n\n")))
    slots = {
        "who": F.col("_who"),
        "year": F.col("_year"),
        "labels": F.col("_labels"),
        "draw": F.col("descriptor") if "descriptor" in have else F.lit("is an ordinary member of the group"),
        "brief": brief,
        "items": items,
        "persona": F.col("_persona"),
        "question": F.col("_question"),
    }
    rows = rows.withColumn("_t", F.explode(table)).withColumn("_user", _slot(F.col("_t.user"), slots))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.when(F.col("_t.system") == "", F.array(message("user", F.col("_user")))).otherwise(
        F.array(message("system", F.col("_t.system")), message("user", F.col("_user")))
    )
    kept = ["record_id", *(["draw"] if "draw" in have else []), F.col("_t.style").alias("style"), messages.alias("messages")]
    return rows.select(*kept).withColumn("key", keys.request_key(F.col("messages")))


def ask_cells(questions: DataFrame) -> DataFrame:
    """Free questions (id, question, options as ``a; b; c``) to cells with lettered options and a uniform truth."""
    rows = questions.withColumn("_o", describe.option_list(F.col("options"))).filter(F.size("_o") >= 2)
    labels = F.transform("_o", lambda o: o["label"])
    text = F.concat(describe.strip(F.col("question")), F.lit("\n\nOptions:\n"), describe.option_block(F.col("_o")))
    return rows.select(
        F.col("id").cast("string").alias("record_id"),
        F.lit("__ask__").alias("dataset"),
        F.lit("pop").alias("split"),
        text.alias("question"),
        labels.alias("options"),
        dist.as_map(labels, dist.uniform(labels)).alias("truth"),
        F.map_from_entries("_o").alias("answer_options"),
        F.lit("").alias("group_prompt"),
        F.from_json(F.lit("{}"), "map<string,string>").alias("segment"),
        F.lit(0).alias("n_grouping_vars"),
    )


def classify_stems(cells: DataFrame, labels: DataFrame, vocabulary: Sequence[str] = describe.KINDS) -> DataFrame:
    """Kinds from noisy label texts, one per distinct stem; off-vocabulary labels fall back to the rules.

    ``labels`` has (stem, text).  Stems meet by their hash and the rules are applied first, so no
    question text is moved.
    """
    stem_hash = F.sha2(describe.strip(F.col("question")), 256)
    rule = describe.task_kind(F.col("question"), F.col("group_prompt"), F.col("options"))
    stems = cells.select("record_id", stem_hash.alias("_h"), rule.alias("_rule"))
    per_stem = labels.select(F.sha2("stem", 256).alias("_h"), "text").dropDuplicates(["_h"])
    joined = stems.join(per_stem, ["_h"], "left")
    return joined.select("record_id", describe.snap(F.coalesce("text", F.lit("")), vocabulary, F.col("_rule")).alias("kind"))
