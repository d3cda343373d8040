"""Describing questions and segments in words: stems, places, kinds, phrases, option blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plurality.functions import dist

# Segment variable -> (concept, phrase, order of the phrase) (fixed values).
VARIABLES = {
    "country": ("country", "from {value}", 0),
    "cntry": ("country", "from {value}", 0),
    "CREGION": ("region", "from the {value} region", 1),
    "age_group": ("age", "in the {value} age group", 2),
    "age": ("age", "in the {value} age group", 2),
    "AGE": ("age", "in the {value} age group", 2),
    "gender": ("gender", "who are {value}", 3),
    "gndr": ("gender", "who are {value}", 3),
    "SEX": ("gender", "who are {value}", 3),
    "RACE": ("race", "whose race is {value}", 4),
    "education": ("education", "whose education level is {value}", 5),
    "EDUCATION": ("education", "whose highest level of education is {value}", 5),
    "eisced": ("education", "whose education level is {value}", 5),
    "highest_education": ("education", "with {value}", 5),
    "INCOME": ("income", "with an annual income of {value}", 5),
    "income": ("income", "whose income level is {value}", 5),
    "household_income": ("income", "whose household finances are such that {value}", 5),
    "subjective_income": ("income strain", "who report their income falls short {value}", 5),
    "topbot": ("social standing", "who place themselves at {value} on a 0-10 social-standing scale", 5),
    "MARITAL": ("marital status", "whose marital status is {value}", 5),
    "marital_status": ("marital status", "whose marital status is {value}", 5),
    "maritalb": ("marital status", "whose marital status is {value}", 5),
    "religion": ("religion", "who identify religiously as {value}", 5),
    "RELIG": ("religion", "who identify religiously as {value}", 5),
    "religiosity": ("religiosity", "who are {value}", 5),
    "rlgdgr": ("religiosity", "whose religiosity is {value} on a 0-10 scale", 5),
    "RELIGATTEND": ("religious attendance", "who attend religious services {value}", 5),
    "POLIDEOLOGY": ("political ideology", "who consider themselves {value}", 5),
    "POLPARTY": ("political party", "who identify politically as {value}", 5),
    "political_group": ("political group", "in political group {value}", 5),
    "lrscale": ("political orientation", "who place themselves at {value} on a 0-10 left-right scale", 5),
    "discuss_politics": ("political engagement", "who discuss politics {value}", 5),
    "employment": ("employment", "whose work status is {value}", 5),
    "employment_status": ("employment", "who are {value}", 5),
    "work_status": ("employment", "whose work status is {value}", 5),
    "mnactic": ("employment", "whose main activity is {value}", 5),
    "domicil": ("locality", "who live in {value}", 5),
    "urban_rural": ("locality", "from a {value} area", 5),
    "city_size": ("city size", "who live somewhere that {value}", 5),
}
UNKNOWN_ORDER = 9

# Task kinds, their cues in question, prompt and options, and the routes taken (fixed values).
KINDS = ("opinion_survey", "knowledge", "risky_choice", "moral_dilemma", "personality_scale", "other")
KIND_ROUTES = {
    "opinion_survey": "task_context",
    "knowledge": "task_context",
    "risky_choice": "abstain",
    "moral_dilemma": "abstain",
    "personality_scale": "base",
    "other": "base",
}
GAMBLE_WORDS = ("gambling machine", "lottery", "gamble")
MORAL_WORDS = ("moral dilemma", "self-driving", "brake failure", "swerve", "pedestrian", "moral machine")
ORDINAL_WORDS = ("disagree", "agree", "very good", "very bad", "strongly", "somewhat", "approve", "oppose")
SURVEY_WORDS = (
    "survey",
    "european social survey",
    "afrobarometer",
    "latinobarómetro",
    "latinobarometro",
    "issp",
    "opinion",
)
CHANCE_PATTERN = r"\d+(\.\d+)?%|chance"
YEAR_PATTERN = r"[Tt]he year is (\d{4})"
PLACE_PATTERN = r"[Yy]ou are from ([^.]+)\."

SPACE = r"[\s\pZ]+"


def _any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}", ""), f"{SPACE}$", "")


def question_stem(question: Column, limit: int = 220) -> Column:
    """One line of question text up to its option list, cut to ``limit`` characters with an ellipsis."""
    for mark in ("Options:", "Options\n"):
        if mark == "Options:":
            head = F.when(F.contains(question, F.lit(mark)), F.substring_index(question, mark, 1))
        else:
            head = head.when(F.contains(question, F.lit(mark)), F.substring_index(question, mark, 1))
    head = head.otherwise(question)
    line = F.trim(F.regexp_replace(head, SPACE, " "))
    return dist.let(
        line, lambda t: F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("…"))).otherwise(t)
    )


def _found(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)
    return F.when(hit != "", hit)


def year_of(prompt: Column) -> Column:
    return _found(prompt, YEAR_PATTERN)


def place_of(segment: Column, prompt: Column) -> Column:
    """Country from the segment, else from the prompt."""
    own = lambda k: F.nullif(F.try_element_at(segment, F.lit(k)), F.lit(""))
    return F.coalesce(own("country"), own("cntry"), F.trim(_found(prompt, PLACE_PATTERN)))


def _variables(table: Mapping[str, tuple[str, str, int]]) -> Column:
    entries = []
    for name, (label, phrase, order) in table.items():
        entries += [
            F.lit(name),
            F.struct(F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), F.lit(order).alias("order")),
        ]
    return F.create_map(*entries)


def clean_value(value: Column) -> Column:
    """Trimmed, without the ``.0`` of a whole scale code."""
    t = F.trim(value)
    return F.when(F.rlike(t, F.lit(r"^-?\d+\.0$")), F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)


def concept(key: Column, table: Mapping[str, tuple[str, str, int]] = VARIABLES) -> Column:
    plain = F.lower(F.trim(F.replace(key, F.lit("_"), F.lit(" "))))
    return F.coalesce(F.try_element_at(_variables(table), key)["label"], plain)


def segment_phrase(
    segment: Column, place: Column | None = None, table: Mapping[str, tuple[str, str, int]] = VARIABLES
) -> Column:
    """Segment as a phrase, country and age first; variables without an entry get a generic wording.

    Equal orders are settled by variable name.  An implied place leads when the segment has no country.
    """
    specs = _variables(table)

    def piece(e: Column) -> Column:
        spec = F.try_element_at(specs, e["key"])
        generic = F.concat(F.lit("whose "), concept(e["key"], table), F.lit(" is {value}"))
        phrase = F.replace(F.coalesce(spec["phrase"], generic), F.lit("{value}"), clean_value(e["value"]))
        return F.struct(F.coalesce(spec["order"], F.lit(UNKNOWN_ORDER)).alias("order"), e["key"].alias("k"), phrase.alias("t"))

    pieces = F.transform(F.map_entries(segment), piece)
    if place is not None:
        bare = ~(F.map_contains_key(segment, F.lit("country")) | F.map_contains_key(segment, F.lit("cntry")))
        lead = F.struct(F.lit(0).alias("order"), F.lit("").alias("k"), F.concat(F.lit("from "), place).alias("t"))
        pieces = F.when(bare & place.isNotNull(), F.concat(F.array(lead), pieces)).otherwise(pieces)
    return F.array_join(F.transform(F.array_sort(pieces), lambda s: s["t"]), ", ")


def task_kind(question: Column, prompt: Column, options: Column) -> Column:
    """Kind of task from ordered surface rules; the first that fits decides."""
    t, g = F.lower(question), F.lower(F.coalesce(prompt, F.lit("")))
    o = F.lower(F.array_join(options, " "))
    money = F.contains(question, F.lit("$")) & F.rlike(t, F.lit(CHANCE_PATTERN))
    return (
        F.when(_any(t, GAMBLE_WORDS) | money, "risky_choice")
        .when(_any(t, MORAL_WORDS), "moral_dilemma")
        .when(
            F.contains(t, F.lit("indicate your level of agreement")) | F.contains(g, F.lit("openpsychometrics")),
            "personality_scale",
        )
        .when(
            F.contains(t, F.lit("number game"))
            | F.contains(g, F.lit("wisdom of crowds"))
            | F.contains(t, F.lit("general knowledge")),
            "knowledge",
        )
        .when(_any(o, ORDINAL_WORDS) | _any(g, SURVEY_WORDS), "opinion_survey")
        .otherwise("other")
    )


def snap(text: Column, vocabulary: Sequence[str], fallback: Column | str) -> Column:
    """First vocabulary item the text contains, ignoring case, else the fallback."""
    low = F.lower(F.trim(text))
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    exact = F.when(low.isin(*vocabulary), low)
    words = F.array(*[F.lit(v) for v in vocabulary])
    return F.coalesce(exact, F.get(F.filter(words, lambda v: F.contains(low, v)), 0), fallback)


def option_list(text: Column) -> Column:
    """``"yes; no"`` to lettered options: array of (label, text); empty pieces are dropped."""
    pieces = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(pieces, lambda p, i: F.struct(F.char(65 + i).alias("label"), p.alias("text")))


def option_block(options: Column) -> Column:
    """Lettered options as the lines of a question."""
    return F.array_join(F.transform(options, lambda o: F.concat(F.lit("("), o["label"], F.lit("): "), o["text"])), "\n")
