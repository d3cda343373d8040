"""Census-like personas: matching them to segments and drawing fixed panels.

Each persona carries at most five axes.  It is written under the key of every axis set in
use (all subsets of five axes at most), so matching a segment is one equi-join on the
segment key; personas and segments are never compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import keys
from plurality.plans.ranking import top_per_group
from plurality.plans.skew import attach

MIN_AGE = 18

# Segment values a persona can be matched on, and the persona codes behind them (fixed values).
AGE_BINS = {"18-29": (18, 29), "30-49": (30, 49), "50-64": (50, 64), "65+": (65, 200)}
SEX_VALUES = {"female": "Female", "male": "Male"}
EDUCATION_CODES = {
    "less than high school": ("less_than_9th", "9th_12th_no_diploma"),
    "high school graduate": ("high_school",),
    "some college, no degree": ("some_college",),
    "associate's degree": ("associates",),
    "college graduate/some postgrad": ("bachelors",),
    "postgraduate": ("graduate",),
}
MARITAL_CODES = {
    "married": "married_present",
    "never been married": "never_married",
    "divorced": "divorced",
    "widowed": "widowed",
}
REGION_STATES = {
    "Northeast": ("CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"),
    "Midwest": ("IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    "South": ("DE", "FL", "GA", "MD", "NC", "SC", "VA", "DC", "WV", "AL", "KY", "MS", "TN", "AR", "LA", "OK", "TX"),
    "West": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA"),
}
AXES = ("AGE", "CREGION", "EDUCATION", "MARITAL", "SEX")

# Prose for coded values (fixed values).
MARITAL_PROSE = {
    "married_present": "married",
    "never_married": "never married",
    "divorced": "divorced",
    "widowed": "widowed",
    "separated": "separated",
}
EDUCATION_PROSE = {
    "less_than_9th": "less than a 9th-grade education",
    "9th_12th_no_diploma": "some high school but no diploma",
    "high_school": "a high-school diploma",
    "some_college": "some college",
    "associates": "an associate's degree",
    "bachelors": "a bachelor's degree",
    "graduate": "a graduate degree",
}
NO_JOB = ("not in workforce", "unemployed", "retired", "homemaker", "student", "disabled")


def _lookup(pairs: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), value)


def adults(personas: DataFrame, min_age: int = MIN_AGE) -> DataFrame:
    return personas.filter(F.col("age") >= min_age)


def region_of(state: Column) -> Column:
    return _lookup({s: r for r, states in REGION_STATES.items() for s in states}, state)


def axis_values() -> dict[str, Column]:
    """The segment value a persona has on every axis, NULL where it has none."""
    age = None
    for label, (lo, hi) in AGE_BINS.items():
        hit = F.col("age").between(lo, hi)
        age = F.when(hit, label) if age is None else age.when(hit, label)
    return {
        "AGE": age,
        "CREGION": region_of(F.col("state")),
        "EDUCATION": _lookup({c: label for label, codes in EDUCATION_CODES.items() for c in codes}, F.col("education_level")),
        "MARITAL": _lookup({code: label for label, code in MARITAL_CODES.items()}, F.col("marital_status")),
        "SEX": _lookup({code: label for label, code in SEX_VALUES.items()}, F.col("sex")),
    }


def is_matchable(segment: Column) -> Column:
    """True when every entry of the segment is a known axis with a known value."""
    known = {
        "AGE": list(AGE_BINS),
        "CREGION": list(REGION_STATES),
        "EDUCATION": list(EDUCATION_CODES),
        "MARITAL": list(MARITAL_CODES),
        "SEX": list(SEX_VALUES),
    }
    pairs = F.array(*[F.lit(f"{axis}={v}") for axis, values in known.items() for v in values])
    return F.forall(F.map_entries(segment), lambda e: F.array_contains(pairs, F.concat_ws("=", e["key"], e["value"])))


def persona_keys(personas: DataFrame, axis_sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(uuid, segment_key) for every axis set; the empty set is the whole population."""
    if axis_sets is None:
        axis_sets = [c for r in range(len(AXES) + 1) for c in combinations(AXES, r)]
    values = axis_values()
    rows = personas.select("uuid", *[F.concat(F.lit(f"{a}="), v).alias(a) for a, v in values.items()])
    made = []
    for axes in axis_sets:
        whole = F.lit(True)
        for a in axes:
            whole = whole & F.col(a).isNotNull()
        made.append(F.when(whole, F.concat_ws("|", *sorted(axes)) if axes else F.lit("<pop>")))
    exploded = rows.select("uuid", F.explode(F.array(*made)).alias("segment_key"))
    return exploded.filter(F.col("segment_key").isNotNull())


def matches(segments: DataFrame, personas: DataFrame) -> DataFrame:
    """(segment_key, uuid) of all adults that fit each matchable segment.

    Only axis sets that occur are generated: at most all subsets of five axes reach the driver.
    """
    wanted = segments.filter(is_matchable(F.col("segment"))).select(
        keys.segment_key(F.col("segment")).alias("segment_key"), F.array_sort(F.map_keys("segment")).alias("axes")
    )
    axis_sets = [r["axes"] for r in wanted.select("axes").distinct().collect()]
    people = persona_keys(adults(personas), axis_sets)
    return attach(people, wanted.select("segment_key").distinct(), ["segment_key"], ["uuid"], "inner")


def pool_sizes(segments: DataFrame, personas: DataFrame) -> DataFrame:
    return matches(segments, personas).groupBy("segment_key").agg(F.count(F.lit(1)).alias("pool"))


def panels(segments: DataFrame, personas: DataFrame, k: int, min_pool: int = 10, seed: int = 0) -> DataFrame:
    """Up to ``k`` personas per segment in seeded hash order; segments with too small a pool get none.

    The draw depends only on segment, seed and persona, so all questions of a segment share it.
    """
    fits = matches(segments, personas)
    order = keys.hash_order(seed, F.col("segment_key"), F.col("uuid"))
    picked = top_per_group(fits.withColumn("_o", order), ["segment_key"], [F.col("_o")], k, ["uuid"], rank="draw")
    pools = fits.groupBy("segment_key").agg(F.count(F.lit(1)).alias("pool")).filter(F.col("pool") >= min_pool)
    return picked.drop("_o").join(pools, "segment_key")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def render_persona(mode: str = "summary") -> Column:
    """Persona row to text: the one-sentence summary, or a header with the narrative fields."""
    persona = F.trim(_text("persona"))
    if mode == "summary":
        return persona
    plain = lambda c: F.replace(_text(c), F.lit("_"), F.lit(" "))
    job = plain("occupation")
    clause = (
        F.when(job == "", F.lit(""))
        .when(job.isin(*NO_JOB), F.concat(F.lit(", "), job))
        .otherwise(F.concat(F.lit(", working as a "), job))
    )
    marital = F.coalesce(_lookup(MARITAL_PROSE, _text("marital_status")), plain("marital_status"))
    education = F.coalesce(_lookup(EDUCATION_PROSE, _text("education_level")), plain("education_level"))
    header = F.concat(
        F.lit("A "), F.coalesce(F.col("age"), F.lit(0)).cast("string"), F.lit("-year-old "), F.lower(_text("sex")), F.lit(", "),
        marital, F.lit(", with "), education, clause, F.lit(", living in "), _text("city"), F.lit(", "), _text("state"), F.lit("."),
    )
    line = lambda label, c: F.when(F.trim(_text(c)) != "", F.concat(F.lit(f"{label}: "), F.trim(_text(c))))
    return F.concat_ws(
        "\n",
        header,
        F.when(persona != "", persona),
        line("Work", "professional_persona"),
        line("Background", "cultural_background"),
        line("Interests", "hobbies_and_interests"),
    )
