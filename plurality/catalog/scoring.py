"""Scores, toplines, splits of the score, and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.catalog.base import R, VIEWS, r6, replicates, rounded, scored
from plurality.operators import bootstrap, evaluate
from plurality.sources import tables

B = 2000


def normalizer_table(spark, sf):
    return rounded(evaluate.normalizers(tables.cells(spark, sf)), "z")


def evaluate_rows(spark, sf):
    rows = scored(spark, sf)
    return rows.select(
        "record_id",
        "system",
        "n_options",
        "is_population",
        "group_size",
        r6("truth_entropy").alias("truth_entropy"),
        r6("tvd").alias("tvd"),
        r6("score").alias("score"),
    )


def score_by_dataset(spark, sf):
    out = evaluate.score_by(scored(spark, sf), ["system", "dataset"], n_boot=B)
    return rounded(out, "mean", "ci_low", "ci_high")


def topline(spark, sf):
    out = evaluate.topline(scored(spark, sf), n_boot=B)
    return rounded(out, "mean", "ci_low", "ci_high", "frac_below_uniform")


def split_stats(spark, sf):
    out = evaluate.split_stats(scored(spark, sf), n_boot=B)
    return rounded(out, "grouped", "pop", "pooled", "g_lo", "g_hi", "g_hw", "split_avg")


def sweep_pivot(spark, sf):
    """The two halves of the records stand in for two models, written as ``model::system`` labels."""
    from plurality.functions import keys

    rows = scored(spark, sf)
    model = F.when(keys.hash_unit(0, F.col("record_id")) < 0.5, F.lit("model_a")).otherwise(F.lit("model_b"))
    labelled = rows.withColumn("label", F.concat_ws("::", model, F.col("system")))
    parts = F.split("label", "::")
    split = labelled.withColumns({"system": F.get(parts, F.lit(1)), "_m": F.get(parts, F.lit(0))})
    return rounded(evaluate.sweep(split, F.col("_m"), ["model_a", "model_b"]), "model_a", "model_b")


def score_by_question(spark, sf):
    """Mean score of every question and system with its interval."""
    out = bootstrap.bootstrap_ci(scored(spark, sf), ["system", "dataset", "question"], "score", n_boot=B).drop("below_zero")
    return rounded(out, "mean", "ci_low", "ci_high")


def bootstrap_overall(spark, sf):
    """Mean score of each system with its interval."""
    out = bootstrap.bootstrap_ci(scored(spark, sf), ["system"], "score", n_boot=B, seed=7).drop("below_zero")
    return rounded(out, "mean", "ci_low", "ci_high")


def bootstrap_eta(spark, sf):
    return rounded(bootstrap.noise_scale(scored(spark, sf), ["system"], "score", 1.0, n_boot=B), "eta")


QUERIES = {
    "normalizers": normalizer_table,
    "evaluate": evaluate_rows,
    "score_by_dataset": score_by_dataset,
    "topline": topline,
    "split_stats": split_stats,
    "sweep_pivot": sweep_pivot,
    "score_by_question": score_by_question,
    "bootstrap_ci": bootstrap_overall,
    "bootstrap_eta": bootstrap_eta,
}

SQL = {
    "normalizers": f"{VIEWS} SELECT split, dataset, {R('z')} AS z FROM norm",
    "evaluate": f"""{VIEWS} SELECT record_id, system, k AS n_options, split = 'pop' AS is_population, CAST(size AS BIGINT) AS group_size,
      {R('te')} AS truth_entropy, {R('tvd')} AS tvd, {R('score')} AS score FROM scored""",
    "score_by_dataset": f"""{VIEWS}, {replicates('scored', 'system, dataset', 'score', B)}
      SELECT system, dataset, n, {R('mean')} AS mean, {R('lo')} AS ci_low, {R('hi')} AS ci_high
      FROM (SELECT system, dataset, count(*) AS n, avg(score) AS mean FROM scored GROUP BY ALL)
      JOIN (SELECT system, dataset, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY ALL)
      USING (system, dataset)""",
    "score_by_question": f"""{VIEWS}, {replicates('scored', 'system, dataset, question', 'score', B)}
      SELECT system, dataset, question, n, {R('mean')} AS mean, {R('lo')} AS ci_low, {R('hi')} AS ci_high
      FROM (SELECT system, dataset, question, count(*) AS n, avg(score) AS mean FROM scored GROUP BY ALL)
      JOIN (SELECT system, dataset, question, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY ALL)
      USING (system, dataset, question)""",
    "topline": f"""{VIEWS}, {replicates('scored', 'system', 'score', B)}
      SELECT system, n, {R('mean')} AS mean, {R('lo')} AS ci_low, {R('hi')} AS ci_high, {R('below')} AS frac_below_uniform
      FROM (SELECT system, count(*) AS n, avg(score) AS mean, avg((score < 0)::INT) AS below FROM scored GROUP BY ALL)
      JOIN (SELECT system, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY ALL) USING (system)""",
    "split_stats": f"""{VIEWS}, g AS (SELECT * FROM scored WHERE split = 'grouped'), {replicates('g', 'system', 'score', B)}
      SELECT system, n, {R('grouped')} AS grouped, {R('pop')} AS pop, {R('pooled')} AS pooled, {R('lo')} AS g_lo, {R('hi')} AS g_hi,
        {R('(hi - lo) / 2')} AS g_hw, {R('(grouped + pop) / 2')} AS split_avg
      FROM (SELECT system, count(*) AS n, avg(score) FILTER (WHERE split = 'grouped') AS grouped,
          avg(score) FILTER (WHERE split = 'pop') AS pop, avg(score) AS pooled FROM scored GROUP BY ALL)
      JOIN (SELECT system, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY ALL) USING (system)""",
    "sweep_pivot": f"""{VIEWS} SELECT system, {R('avg(score) FILTER (WHERE u < 0.5)')} AS model_a, {R('avg(score) FILTER (WHERE u >= 0.5)')} AS model_b
      FROM (SELECT system, score, ('0x' || substr(sha256('0::' || record_id), 1, 16))::UBIGINT / 18446744073709551616.0 AS u FROM scored) GROUP BY system""",
    "bootstrap_ci": f"""{VIEWS}, {replicates('scored', 'system', 'score', B, 7)}
      SELECT system, n, {R('mean')} AS mean, {R('lo')} AS ci_low, {R('hi')} AS ci_high FROM (SELECT system, count(*) AS n, avg(score) AS mean FROM scored GROUP BY system)
      JOIN (SELECT system, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM boot GROUP BY system) USING (system)""",
    "bootstrap_eta": f"""{VIEWS}, {replicates('scored', 'system', 'score', B)}
      SELECT system, {R('stddev_pop(mean)')} AS eta FROM boot GROUP BY system""",
}
