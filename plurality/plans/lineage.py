"""Cutting long lineages through the shared checkpoint folder.

One rule everywhere: intermediates go to the folder in ``spark.checkpoint.dir``, or to the one given to
``SparkContext.setCheckpointDir``.  Without either nothing is written and an error says so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROWS_PER_FILE = 500_000
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediates."""
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, remembered for ``clean``."""
    path = f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Remove what this process wrote by ``scratch``; DataFrames that still read it can no longer be used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str, spread: str | None = None, rows: int = 0) -> DataFrame:
    """Write once to the shared folder and read back: no recomputation, and scans of it prune and push down.

    ``spread`` hashes the rows by that column over at least one file per core (more when about
    ``rows`` rows are expected), so that heavy per-row expressions on a small table use every core.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    files = max(spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE)
    out = df if spread is None else df.repartition(files, spread)
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
