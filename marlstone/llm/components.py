"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: bigint); component is the least node reachable.

    All rounds are joins and partial aggregates over the edge table, which
    shrinks to one star for each component; nothing is collected. Self-loops
    and repeated edges do no harm; rows with a null end are left out. An
    empty table gives an empty result.
    """
    now = scratch.put(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        after = scratch.put(_small_star(_large_star(now)))
        new = _mark(after)
        scratch.drop(now)
        now = after
        if new == mark:
            break
        mark = new
    child = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return child.union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal when a round changed nothing."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least node among u and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
