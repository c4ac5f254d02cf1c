"""Deterministic samples: ranks from hashes, top rows of each group, strata in turn, tiers, fixed-size batches.

Every order is total, so a sample depends on the data and the seed and not on
how rows are spread. ``row_number() <= n`` filters are cut to n rows in each
task before any shuffle, so a group may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The seed that published samples were drawn with.
SEED = 20240917


def rank_key(key: Column, seed: int | str = SEED) -> Column:
    """Stable order key: sha256 of ``seed:key``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def take_top(df: DataFrame, n: int, key: str, groups: list[str], seed: int = SEED) -> DataFrame:
    """The first n rows of each group by rank."""
    order = Window.partitionBy(*groups).orderBy(rank_key(F.col(key), seed), F.col(key))
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, n: int, key: str, stratum: str, seed: int = SEED) -> DataFrame:
    """n rows taken one from each stratum in turn, strata in order; then put in an order of their own (``position`` from 1)."""
    turn = Window.partitionBy(stratum).orderBy(rank_key(F.col(key), seed), F.col(key))
    turns = df.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n)
    chosen = turns.orderBy("_turn", stratum).limit(n).drop("_turn")
    again = Window.orderBy(rank_key(F.concat(F.lit("order:"), F.col(key).cast("string")), seed), F.col(key))
    return chosen.withColumn("position", F.row_number().over(again))  # n rows at most


def tiered_fill(df: DataFrame, n: int, key: str, tier: Column, seed: int = SEED) -> DataFrame:
    """n rows, all of a lower tier before any of a higher one, by rank within a tier; rows without a tier are left out."""
    own = df.withColumn("tier", tier).where("tier is not null")
    return own.orderBy("tier", rank_key(F.col(key), seed), key).limit(n)


def row_index(df: DataFrame, groups: list[str], key: str, width: int = 10_000, name: str = "index") -> DataFrame:
    """0-based position of each row by a bigint key within its groups, without one task for a whole group.

    Keys are cut into ranges of ``width``; positions are counted within a
    range and shifted by the sizes of those before it, of which there is one
    row for each range. Rows whose keys repeat are ordered arbitrarily among themselves.
    """
    own = df.withColumn("_range", F.floor(F.col(key) / width))
    sizes = own.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*groups, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*groups, "_range").orderBy(key)
    same = [*groups, "_range"]
    return own.withColumn("_k", F.row_number().over(inside)).join(shifts, same).withColumn(name, F.col("_shift") + F.col("_k") - 1).drop("_range", "_k", "_shift")


def batches(df: DataFrame, size: int, groups: list[str], key: str) -> DataFrame:
    """One row for each ``size`` consecutive rows of a group: (groups, batch, items in order)."""
    indexed = row_index(df, groups, key)
    item = F.struct("index", F.col(key).alias("item"))
    made = indexed.groupBy(*groups, F.floor(F.col("index") / size).alias("batch")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return made.select(*groups, "batch", F.transform("_items", lambda x: x["item"]).alias("items"))


def cases(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Two rows or more of each: ``pairs`` of (label, column of the candidate), numbered in their order by case_no."""
    made = F.array(*[F.struct(F.lit(k).alias("case_no"), F.lit(label).alias("gold_label"), F.col(c).alias("candidate")) for k, (label, c) in enumerate(pairs)])
    return df.select("*", F.inline(made))
