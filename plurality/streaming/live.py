"""Scoring and totals over streams of responses.

The row-wise functions take a streaming DataFrame as they are; what follows wires them to
static cell and normalizer tables.  Totals need ``complete`` or ``update`` output.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plurality.functions import dist, text
from plurality.operators.runlog import cost


def score_stream(completions: DataFrame, cells: DataFrame, norms: DataFrame) -> DataFrame:
    """Parse and score arriving responses (record_id, system, text) against static cells.

    Both joins are stream-static; unreadable responses score as uniform and are flagged.
    """
    truth = cells.select(
        "record_id",
        "dataset",
        "split",
        "options",
        dist.renorm(dist.align(F.col("truth"), F.col("options"))).alias("p"),
    ).join(norms, ["split", "dataset"], "left")
    rows = completions.join(truth, "record_id")
    rows = rows.withColumn("_v", text.stated_vector(F.col("text"), F.col("options")))
    q = dist.renorm(F.coalesce("_v", dist.uniform(F.col("options"))))
    rows = rows.withColumn("q", q).withColumn("tvd", dist.tvd(F.col("p"), F.col("q")))
    z = F.coalesce("z", dist.tvd_to_uniform(F.col("p")))
    return rows.select(
        "record_id", "system", "dataset", "split", F.col("_v").isNull().alias("parse_failed"), dist.skill(F.col("tvd"), z).alias("score")
    )


def vote_counts(votes: DataFrame, cells: DataFrame) -> DataFrame:
    """Running count of votes per record and option; unreadable votes count under NULL."""
    parsed = votes.join(cells.select("record_id", "options"), "record_id")
    return parsed.groupBy("record_id", text.vote(F.col("text"), F.col("options")).alias("option")).agg(F.count(F.lit(1)).alias("n"))


def usage_totals(usage: DataFrame, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Running calls, tokens and cost per model."""
    return usage.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.sum(cost(prices)).alias("cost_usd"),
    )


LOG_ROW = ("node_id", "config_hash", "val_score", "cost_usd")
PROGRESS = "run_id string, seq long, node_id string, val_score double, step long, best_so_far double, is_new_best boolean, cum_cost_usd double, k long"


class RunProgress(StatefulProcessor):
    """Per run: the next position, the running values, the configurations seen, and rows that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "next long, step long, best double, cum double, k long")
        self.seen = handle.getMapState("seen", "config_hash string", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "node_id string, config_hash string, val_score double, cost_usd double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, step, best, cum, k = self.totals.get() if self.totals.exists() else (0, 0, None, 0.0, 0)
        arrived: dict[int, tuple] = {}
        for part in rows:
            plain = part[["seq", *LOG_ROW]].astype(object)
            for seq, *row in plain.where(plain.notna(), None).itertuples(index=False):
                if seq >= upto:  # earlier ones are repeats
                    arrived.setdefault(int(seq), tuple(row))
        out = []
        while True:
            if self.waiting.containsKey((upto,)):
                row = self.waiting.getValue((upto,))
                self.waiting.removeKey((upto,))
                arrived.pop(upto, None)
            elif upto in arrived:
                row = arrived.pop(upto)
            else:
                break
            node, config, val, cost_usd = row
            new = val is not None and (best is None or val > best)
            if val is not None:
                step, best = step + 1, val if new else best
                if config is not None and not self.seen.containsKey((config,)):
                    self.seen.updateValue((config,), (upto,))
                    k += 1
            cum += cost_usd or 0.0
            out.append((key[0], upto, node, val, step if val is not None else None, best, new, cum, k))
            upto += 1
        for seq, row in arrived.items():
            if not self.waiting.containsKey((seq,)):
                self.waiting.updateValue((seq,), row)
        self.totals.update((upto, step, best, cum, k))
        names = [c.split()[0] for c in PROGRESS.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"step": "Int64", "val_score": "Float64", "best_so_far": "Float64"})

    def close(self) -> None:
        pass


def run_progress(log: DataFrame) -> DataFrame:
    """Along a stream of log rows, each node once and in order: best value, step, cost and distinct configurations so far.

    ``seq`` numbers the nodes of a run from 0 without gaps.  Rows may arrive in any order and more than once: one that is ahead waits
    in the state until those before it are there, a repeat is ignored.  A row that never arrives holds back what follows it.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``); what a run keeps grows with its
    configurations, not with its nodes.
    """
    rows = log.select("run_id", "seq", *LOG_ROW)
    return rows.groupBy("run_id").transformWithStateInPandas(RunProgress(), outputStructType=PROGRESS, outputMode="Append", timeMode="None")
