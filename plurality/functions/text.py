"""Column functions that read answers out of response text and describe questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plurality.functions import dist

# Patterns of the response format (fixed values).
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BARE_OBJECT = r"(?s)\{.*\}"


def json_object(text: Column) -> Column:
    """Object inside a response as text -> text: the first fenced block if any, else first brace to last."""
    fenced = F.regexp_extract(text, FENCED_OBJECT, 1)
    bare = F.regexp_extract(text, BARE_OBJECT, 0)
    found = F.when(fenced != "", fenced).when(bare != "", bare)
    return F.from_json(found, "map<string,string>")


def vote(text: Column, options: Column) -> Column:
    """The one option a response commits to, or NULL.

    A JSON ``choice`` decides and must be an option; otherwise exactly one label may occur
    as a whole word.  The pattern is only compiled for labels the text contains.
    """

    def by_word(o: Column) -> Column:
        literal = F.replace(o, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
        pattern = F.concat(F.lit(r"(?U)\b\Q"), literal, F.lit(r"\E\b"))
        return F.contains(text, o) & F.rlike(text, pattern)

    return dist.let(
        F.struct(json_object(text).alias("m")),
        lambda s: F.when(
            F.map_contains_key(s["m"], F.lit("choice")),
            F.when(
                F.array_contains(options, F.coalesce(F.trim(F.try_element_at(s["m"], F.lit("choice"))), F.lit(""))),
                F.trim(F.try_element_at(s["m"], F.lit("choice"))),
            ),
        ).otherwise(
            dist.let(F.filter(options, by_word), lambda hits: F.when(F.size(hits) == 1, F.get(hits, 0)))
        ),
    )


def stated_vector(text: Column, options: Column) -> Column:
    """Non-negative vector stated by a response; NULL when it has no object or no mass."""

    def mass(found: Column) -> Column:
        """The last value stated for a label; nothing where it is no finite number."""
        number = F.element_at(found, -1)["value"].try_cast("double")
        return F.when((F.size(found) > 0) & (number > 0) & (number < float("inf")), number).otherwise(F.lit(0.0))

    def numbers(m: Column) -> Column:
        return F.transform(options, lambda o: mass(F.filter(F.map_entries(m), lambda e: e["key"] == o)))

    return dist.let(
        json_object(text),
        lambda m: F.when(m.isNotNull(), dist.let(numbers(m), lambda v: F.when(dist.vsum(v) > 0, v))),
    )
