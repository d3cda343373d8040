"""Streams give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.operators import draws, evaluate, runlog
from plurality.sources import tables
from plurality.streaming import live


def drain(df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_scores_of_a_stream(spark, sf_dir, tmp_path):
    cells, source = tables.cells(spark, sf_dir), str(tmp_path / "in")
    tables.completions(spark, sf_dir).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("record_id string, system string, text string").option("maxFilesPerTrigger", 1).parquet(source)
    norms = evaluate.normalizers(cells)
    got = drain(live.score_stream(stream, cells, norms), "scores", "append", tmp_path)
    preds = draws.parse_predictions(spark.read.parquet(source), cells).drop("parse_failed")
    want = evaluate.evaluate(cells, preds, norms).select("record_id", "system", F.col("score").alias("want"))
    both = got.join(want, ["record_id", "system"])
    assert both.count() == want.count() == got.count()
    assert both.filter(F.abs(F.col("score") - F.col("want")) > 1e-9).count() == 0


def test_running_totals(spark, sf_dir, tmp_path):
    source, prices = str(tmp_path / "usage"), {"model_click": (1.0, 2.0)}
    usage = tables.usage(spark, sf_dir)
    usage.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {r["model"]: r["cost_usd"] for r in drain(live.usage_totals(stream, prices), "totals", "complete", tmp_path).collect()}
    want = {r["model"]: r["cost_usd"] for r in runlog.usage_totals(usage, prices).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_vote_counts(spark, sf_dir, tmp_path):
    source, cells = str(tmp_path / "votes-in"), tables.cells(spark, sf_dir)
    votes = tables.votes(spark, sf_dir)
    votes.write.parquet(source)
    stream = spark.readStream.schema(votes.schema).parquet(source)
    got = drain(live.vote_counts(stream, cells), "votes", "complete", tmp_path)
    tallied = draws.tally_votes(votes, cells).agg(F.sum("n_votes"), F.sum("n_failed")).first()
    readable = got.filter("option IS NOT NULL").agg(F.sum("n")).first()[0]
    assert (readable, got.agg(F.sum("n")).first()[0]) == (tallied[0], tallied[0] + tallied[1])


def test_run_progress_out_of_order_and_restarted(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, sink, state = (str(tmp_path / n) for n in ("log-in", "log-out", "log-state"))
    log = tables.run_log(spark, sf_dir)

    def go():
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(source)
        out = live.run_progress(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        out.awaitTermination()
        return {(r.run_id, r.seq): r for r in spark.read.parquet(sink).collect()}

    part = lambda k: log.filter(F.pmod(F.xxhash64("run_id", "seq"), F.lit(4)) == k)
    for k in (2, 0):
        part(k).coalesce(1).write.mode("append").parquet(source)
    held = go()
    assert len(held) < part(2).count() + part(0).count()  # rows behind a missing one wait
    for k in (1, 0, 3):  # 0 once more: repeats
        part(k).coalesce(1).write.mode("append").parquet(source)
    got = go()
    assert spark.read.parquet(sink).count() == len(got) == log.count() and all(got[at] == held[at] for at in held)
    costs = {(r.run_id, r.seq): r.cum_cost_usd for r in runlog.running_cost(log).collect()}
    counts = {(r.run_id, r.seq): r.k for r in runlog.distinct_so_far(log).collect()}
    assert all(abs(r.cum_cost_usd - costs[at]) < 1e-9 and r.k == counts[at] for at, r in got.items())
    best = sorted((r.run_id, r.step, r.node_id, r.best_so_far, r.is_new_best) for r in runlog.progression(log).collect())
    assert best == sorted((r.run_id, r.step, r.node_id, r.best_so_far, r.is_new_best) for r in got.values() if r.val_score is not None)
