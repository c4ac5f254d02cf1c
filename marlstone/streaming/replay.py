"""The attempt log as a stream: windowed costs with late rows, and guards that keep state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attempts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Attempts as they are appended to a folder of Parquet files; their time ``ts`` becomes a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_costs(rows: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Attempts, failures and cost by window and model; rows later than ``late`` are left out, as state must end."""
    return (
        rows.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "model_id")
        .agg(F.count("*").alias("attempts"), F.count_if(F.col("status") != "SUCCESS").alias("failures"), F.sum("usage_cost").alias("cost"))
        .select(F.col("w.start").alias("start"), "model_id", "attempts", "failures", "cost")
    )


_GUARD = "model_id string, attempts bigint, failures bigint, tripped_at bigint, reason string"


def failure_guard(rows: DataFrame, consecutive: int = 10, rate: float = 0.5, least: int = 20) -> DataFrame:
    """The state of each model's guard after each micro-batch; within one, attempts count in order of ts and event_id.

    The state is five numbers a model, however long the log.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, bad, run, tripped, reason = state.get if state.exists else (0, 0, 0, 0, "")
        for ok in pd.concat(list(frames)).sort_values(["ts", "event_id"])["ok"]:
            n, bad, run = n + 1, bad + (not ok), 0 if ok else run + 1
            if not ok and not tripped:
                reason = "consecutive" if run >= consecutive else "rate" if n >= least and bad / n > rate else ""
                tripped = n if reason else 0
        state.update((n, bad, run, tripped, reason))
        yield pd.DataFrame([{"model_id": key[0], "attempts": n, "failures": bad, "tripped_at": tripped or None, "reason": reason or None}])

    return rows.groupBy("model_id").applyInPandasWithState(step, _GUARD, "n long, bad long, run long, tripped long, reason string", "update", "NoTimeout")


def run_to_end(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives now, as a table in memory; for tests and small replays."""
    query = rows.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
