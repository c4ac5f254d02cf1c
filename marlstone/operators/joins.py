"""Joins between manifests, results, tasks and batches: equi-joins whose strategy is left to Catalyst and AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_results(manifest: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Samples that have a stored result; the others are in no denominator."""
    return manifest.join(results, list(keys or ("sample_id",)), "inner")


def pending(tasks: DataFrame, results: DataFrame, retry_failed: bool = False, force: bool = False, key: str = "cache_key") -> DataFrame:
    """Tasks still to run: those without a success, and without a failure unless failures are to be retried; all if forced."""
    if force:
        return tasks
    known = results if not retry_failed else results.where("status = 'SUCCESS'")
    return tasks.join(known.select(key), key, "left_anti")


def cached(tasks: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """Tasks with a stored success."""
    return tasks.join(results.where("status = 'SUCCESS'").select(key), key, "left_semi")


def marked_cached(tasks: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """``tasks`` with a boolean column cached."""
    hit = results.where("status = 'SUCCESS'").select(key).distinct().withColumn("_hit", F.lit(True))
    return tasks.join(hit, key, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cached_cost(tasks: DataFrame, results: DataFrame, key: str = "cache_key") -> DataFrame:
    """What the stored successes of these tasks cost when they were made."""
    held = results.where("status = 'SUCCESS'").join(tasks.select(key), key, "left_semi")
    return held.agg(F.count("*").alias("hits"), F.coalesce(F.sum("usage_cost"), F.lit(0.0)).alias("cached_cost"))


def missing_metrics(rows: DataFrame, metrics: DataFrame, key: str = "metric_cache_key") -> tuple[DataFrame, DataFrame]:
    """Rows with their cached value, and rows that have none: only these are computed."""
    probed = rows.join(metrics.select(key, "value_json"), key, "left")
    return probed.where("value_json is not null"), probed.where("value_json is null").drop("value_json")


def paired(left: DataFrame, right: DataFrame, key: str, same: str) -> DataFrame:
    """Ids in both that agree on ``same``: (key, same)."""
    other = right.select(F.col(key).alias("_k"), F.col(same).alias("_s"))
    return left.join(other, (F.col(key) == F.col("_k")) & (F.col(same) == F.col("_s")), "left_semi")


def unbatched(batches: DataFrame, answers: Column) -> DataFrame:
    """A row for each item of a batch with the answer at its position: arrays zipped in the row, so that there is no join."""
    own = batches.withColumn("_answers", answers)
    return own.select("*", F.posexplode(F.arrays_zip(F.col("items").alias("item"), F.col("_answers").alias("answer"))).alias("position", "_z")).select(
        *[c for c in batches.columns if c != "items"], (F.col("position") + 1).alias("position"), F.col("_z.item").alias("item"), F.col("_z.answer").alias("answer")
    )


def first_by_priority(*tables: DataFrame, key: str) -> DataFrame:
    """Rows of several tables with the same columns; of equal keys, that of the first table."""
    made = None
    for k, t in enumerate(tables):
        own = t.withColumn("_p", F.lit(k))
        made = own if made is None else made.unionByName(own)
    columns = [c for c in tables[0].columns]
    return made.groupBy(key).agg(F.min_by(F.struct(*columns), "_p").alias("r")).select("r.*")
