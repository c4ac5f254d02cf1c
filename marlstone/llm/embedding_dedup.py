"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are collapsed first. A table's bucket is the signs of a class'
vector against a few random hyperplanes; only members of a bucket are compared,
by blocks of a matrix product inside tasks. A block sends the number of links
of each member and a forest of its links, never its pairs; a pair that shares
buckets in several tables is counted in the first one alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table
from .components import components

#: Least cosine of a link.
COSINE = 0.95
#: Chance that a pair with just the least cosine shares no bucket; the number of tables follows from it.
MISS = 1e-6
#: Members of a bucket that the number of hyperplanes aims at, for vectors without any order.
BUCKET = 256
#: A bucket of more members is cut into parts of about so many, and each two parts meet in a task of their own.
BLOCK = 2048
#: Keys of at most this many large buckets are broadcast.
BROADCAST_ROWS = 200_000
#: Pairs whose cosine is so close to the least one are summed again without rounding.
CLOSE = 1e-9
#: Vectors and hyperplanes are rounded to so many steps a unit for their signs, so that products are exact and signs the same in every task.
STEPS, PLANE_STEPS = 1 << 20, 1 << 10
SEED = 20240917


def tables_for(rows: int, cosine: float = COSINE, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(tables, hyperplanes a table) for so many classes.

    A pair at the least cosine agrees in one sign with p = 1 - angle / pi, so
    it shares no bucket with (1 - p**planes)**tables. More rows take more
    hyperplanes, and with them more tables; the chance of a miss stays.
    """
    planes = min(max(4, math.ceil(math.log2(max(rows, 1) / bucket))), 30)
    share = (1 - math.acos(min(max(cosine, -1.0), 1.0)) / math.pi) ** planes
    return (1, planes) if share >= 1 else (math.ceil(math.log(miss) / math.log1p(-share)), planes)


@lru_cache(maxsize=8)
def planes_of(dims: int, tables: int, planes: int) -> np.ndarray:
    """Random hyperplanes (dims, tables * planes), whole numbers; the same in every task."""
    drawn = np.random.default_rng([SEED, dims, planes]).standard_normal((tables * planes, dims))
    return np.rint(drawn * PLANE_STEPS).T.copy()


def units_of(vectors: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; they are scaled by a power of two first, so that no square overflows or vanishes."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    scaled = np.ldexp(vectors, -power[:, None])
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def keys_of(units: np.ndarray, tables: int, planes: int) -> np.ndarray:
    """The bucket of each row in each table (rows, tables)."""
    if not units.shape[1]:
        return np.zeros((len(units), tables), np.int64)
    signs = np.rint(units * STEPS) @ planes_of(units.shape[1], tables, planes) >= 0
    return signs.reshape(len(units), tables, planes) @ (1 << np.arange(planes, dtype=np.int64))


def usable(vector: Column) -> Column:
    """Whether a vector can link: some component, none null or non-finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length that occurs in a batch."""
    lengths = column.value_lengths().to_numpy()
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat[offsets[at][:, None] + np.arange(d)].astype(np.float64)


def _bucketed(classes: DataFrame, tables: int, planes: int) -> DataFrame:
    """(node, n, vector, dims, table, key): a row for each class and table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.empty((b.num_rows, tables), np.int64)
            for at, vectors in _rows(b.column(2)):
                keys[at] = keys_of(units_of(vectors), tables, planes)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), buckets], names=["node", "n", "vector", "keys"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.mapInArrow(each, f"node bigint, n bigint, vector {kind}, keys array<bigint>").select("node", "n", "vector", F.size("vector").alias("dims"), F.posexplode("keys").alias("table", "key"))


def _cells(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """``buckets`` with own, first, second: the part that a member belongs to and the two parts that a cell compares.

    A bucket of at most BLOCK members is one cell. A larger one is cut into
    parts; each member goes to a cell for every part, itself included, so no pair is lost and no task holds the bucket.
    """
    by = ["dims", "table", "key"]
    large = scratch.put(buckets.groupBy(*by).agg(F.count("*").alias("members")).where(F.col("members") > BLOCK).select(*by, F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")))
    if not large.head(1):
        return buckets.withColumns({c: F.lit(0) for c in ("own", "first", "second")})
    side = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    parted = buckets.join(side, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("node", "n", "vector", *by, "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))


def linked_pairs(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of unit vectors with at least this cosine; sums close to it are taken again without rounding."""
    product = a @ b.T
    i, j = np.nonzero(product >= cosine - CLOSE)
    for k in np.flatnonzero(product[i, j] < cosine + CLOSE).tolist():
        x, y = a[i[k]], b[j[k]]
        exact = math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))
        if exact < cosine:
            i[k] = -1
    return i[i >= 0], j[i >= 0]


def roots_of(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place reachable from each of ``size`` places by links (i, j)."""
    root = np.arange(size)
    while len(i):
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _compared(cells: DataFrame, tables: int, planes: int, cosine: float) -> DataFrame:
    """(a, b, links): with b null the links of class a that a cell has found, else a link or chain of links between classes."""

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, n, own = (rows.column(c).to_numpy() for c in ("node", "n", "own"))
        order = np.argsort(node)
        node, n, own = node[order], n[order], own[order]
        ((_, vectors),) = _rows(rows.column("vector").chunk(0))
        units = units_of(vectors[order])
        table, first, second = key[1].as_py(), key[3].as_py(), key[4].as_py()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        links, found, keys = np.zeros(len(node), np.int64), [], None
        for k in range(0, len(left), 512):
            i, j = linked_pairs(units[left[k : k + 512]], units[right], cosine)
            i, j = left[i + k], right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            if keys is None:
                keys = keys_of(units, tables, planes)
            for t in range(table):  # a pair that met in an earlier table was counted there
                fresh = keys[i, t] != keys[j, t]
                i, j = i[fresh], j[fresh]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            root = roots_of(len(node), i, j)
            found.append(np.stack([np.flatnonzero(root != np.arange(len(node))), root[root != np.arange(len(node))]]))
        counted = np.flatnonzero(links)
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        if len(found) > 1:
            root = roots_of(len(node), a, b)
            a = np.flatnonzero(root != np.arange(len(node)))
            b = root[a]
        other = pa.array(np.concatenate([np.zeros(len(counted), np.int64), node[b]]), mask=np.arange(len(counted) + len(b)) < len(counted))
        return pa.table({"a": pa.array(np.concatenate([node[counted], node[a]])), "b": other, "links": pa.array(np.concatenate([links[counted], np.zeros(len(b), np.int64)]))})

    return cells.groupBy("dims", "table", "key", "first", "second").applyInArrow(each, "a bigint, b bigint, links bigint")


def embedding_groups(embeddings: DataFrame, vector: str = "embedding", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id and an array column).

    Rows whose cosine, in double precision, is at least ``cosine`` link. A
    pair is missed with a chance of at most ``miss``; none below the bound is
    linked. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, and vectors of different lengths do not
    link. Repeated rows each get a row and link with each other. component_id
    is the smallest vec_id reachable, null only where no member has one; kept
    is false for a row without vec_id. Other columns are left out, whatever
    their names; an empty table gives an empty result. vec_id must be a
    whole number.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    bounded_batches(spark)
    kind = embeddings.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    own = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    own = own.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + F.lit(0).cast(kind[6:-1]))))  # -0 and 0 are one value
    own = scratch.put(own.select("vec_id", "vector", F.xxhash64("vector").alias("_h1"), F.xxhash64(F.lit(1), "vector").alias("_h2")))
    named = own.where("vector is not null").groupBy("_h1", "_h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = scratch.put(named.withColumn("node", F.monotonically_increasing_id()))
    tables, planes = tables_for(classes.count(), cosine, miss)
    buckets = scratch.put(_bucketed(classes.select("node", "n", "vector"), tables, planes))
    found = scratch.put(_compared(_cells(buckets, scratch), tables, planes, cosine))
    scratch.drop(buckets)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    group = components(found.where("b is not null").select("a", "b"), scratch)
    joined = classes.select("node", "n", "least", "_h1", "_h2").join(links, F.col("node") == F.col("a"), "left").drop("a")
    joined = scratch.put(joined.join(group.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("_h1", "_h2", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    # Written out, so that a component's members are met through a shuffle whose large partitions can be split.
    first = scratch.put(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    known = joined.join(first, "component").select("_h1", "_h2", "n_links", "component_id")
    alone = own.where("vector is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.where("vector is not null").join(known, ["_h1", "_h2"]).select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
