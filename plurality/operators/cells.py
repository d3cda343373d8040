"""Raw responses to cells: one histogram per question and demographic segment."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.functions import dist, keys

QUESTION = ["dataset", "question"]


def count_answers(responses: DataFrame, dims: Sequence[str], subsets: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Raw answers to counts at the finest grain, in one pass with map-side aggregation.

    ``responses`` has one row per answer: dataset, question, option, the ``dims`` and the
    boolean ``subsets`` columns; each subset adds a count of its rows.  With ``weight``, a row
    stands for that many equal answers.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    counts = [F.sum(n).alias("_n"), *[F.sum(F.when(F.col(s), n).otherwise(F.lit(0))).alias(f"_n_{s}") for s in subsets]]
    return (
        responses.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("NA")) for d in dims})
        .groupBy(*QUESTION, "option", *dims)
        .agg(*counts)
    )


def cells_from_counts(finest: DataFrame, dims: Sequence[str], subsets: Sequence[str] = ()) -> DataFrame:
    """Histograms for every subset of ``dims``.

    Only counts are expanded into the grouping sets, never answers, and options absent
    from a cell are filled with zero.  ``finest`` is read twice (cells, option lists), so
    write it as a table first when the answers behind it are many.
    """
    dims = list(dims)
    sums = [F.sum(c).alias(c) for c in ("_n", *[f"_n_{s}" for s in subsets])]
    sets = [list(c) for r in range(len(dims) + 1) for c in combinations(dims, r)]
    base = [F.col(c) for c in (*QUESTION, "option")]
    rolled = finest.groupingSets(
        [[*base, *[F.col(d) for d in s]] for s in sets], *base, *[F.col(d) for d in dims]
    ).agg(*sums)
    packed = rolled.groupBy(*QUESTION, *dims).agg(
        F.sum("_n").alias("group_size"),
        *[
            F.map_from_entries(F.collect_list(F.struct("option", c))).alias(c)
            for c in ("_n", *[f"_n_{s}" for s in subsets])
        ],
    )
    options = finest.groupBy(*QUESTION).agg(F.sort_array(F.collect_set("option")).alias("options"))
    cells = packed.join(options, QUESTION, "left")

    def shares(c: str):
        """Percentages over all options, scaled to one as numbers: their text would read back as the same numbers."""
        counted = F.transform(
            F.col("options"),
            lambda o: F.when(
                F.col(f"{c}_sum") > 0,
                100.0 * F.coalesce(F.try_element_at(F.col(c), o), F.lit(0)) / F.col(f"{c}_sum"),
            ).otherwise(F.lit(0.0)),
        )
        return F.map_from_arrays("options", dist.renorm(counted))

    for c in ("_n", *[f"_n_{s}" for s in subsets]):
        whole = F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
        cells = cells.withColumn(f"{c}_sum", whole)
    present = F.map_filter(
        F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d))]), lambda _, v: v.isNotNull()
    )
    cells = cells.withColumn("segment", present)
    return cells.select(
        F.concat_ws("|", *QUESTION, keys.segment_key(F.col("segment"))).alias("record_id"),
        "dataset",
        F.when(F.size("segment") == 0, F.lit("pop")).otherwise(F.lit("grouped")).alias("split"),
        "question",
        "options",
        shares("_n").alias("truth"),
        "segment",
        F.array_sort(F.map_keys("segment")).alias("grouping_keys"),
        F.size("segment").alias("n_grouping_vars"),
        "group_size",
        *[shares(f"_n_{s}").alias(s) for s in subsets],
    )
