"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores.  ``cells`` is the pass over the raw
rows that writes the cell table; the other queries start from that table, as analyses of one
survey do (votes, usage, logs, personas and documents are read from the source tables).
BENCH_FRESH=1 drops the cell table before every query, so each time includes the raw pass.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from plurality import catalog
from plurality.plans import lineage
from plurality.sources import tables

HEADLINE = (
    "topline",
    "score_by_dataset",
    "split_stats",
    "normalizers",
    "family_split",
    "stratified",
    "system_summary",
    "entropy_tertiles",
    "reliability",
    "family_entropy",
    "child_weights",
    "post_strat",
    "counterfactual",
    "grid_fit",
    "entropy_target_fit",
    "feature_target",
    "chain",
    "parse_dist",
    "vote_tally",
    "avg_draws",
    "inter_tvd",
    "k_curve",
    "paired_delta",
    "two_fold_select",
    "oracle_ceiling",
    "render_request",
    "panel",
    "ladder_replay",
    "usage_cost",
    "export_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plurality-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load()[0]
    names = sys.argv[1:] or HEADLINE
    fresh = os.environ.get("BENCH_FRESH") == "1"
    queries[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up cost is not a query's
    tables.forget()
    start = time.perf_counter()
    tables.cells(spark, sf_dir)
    seconds = {"cells": round(time.perf_counter() - start, 3)}
    for name in names:
        if fresh:
            tables.forget()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    lineage.clean(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
