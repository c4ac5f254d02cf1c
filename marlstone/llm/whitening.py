"""Embedding whitening: an exact covariance by digit-slice products, then its eigenvectors.

Entries are whole numbers (steps of 1/256). A task splits centred ones into
digits of a few bits, so small that float64 matrix products of a block of rows
are exact, and adds the products up as 64-bit integers. Spark sums the digits'
products over all tasks as decimals; the driver, which gets one number for each
two dimensions and digit place, puts them together as big integers and takes the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table

#: Steps that an entry's unit is cut into.
STEPS = 256
#: Bits of a digit, and rows of a block: a difference of two digits has one bit more at most, so a sum over a block stays within 2**53.
DIGIT_BITS, BLOCK = 19, 1 << 13
#: Blocks whose products are added up before they are sent: 2**10 times 2**53 fits in 64 bits.
FLUSH = 1 << 10
#: Components of a row.
COMPONENTS = 4


def digits_of(x: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of 64-bit integers, least first, as float64; sum(d * 2**(DIGIT_BITS * k)) is x. As many as the largest entry needs."""
    half, rest, out = 1 << (DIGIT_BITS - 1), x, []
    while not out or rest.any():
        low = rest & ((1 << DIGIT_BITS) - 1)
        low = np.where(low >= half, low - (1 << DIGIT_BITS), low)
        out.append(low.astype(np.float64))
        rest = (rest >> DIGIT_BITS) + (low < 0)  # exact also where x - low would not fit
    return out


def centred_digits(x: np.ndarray, middle: np.ndarray) -> list[np.ndarray]:
    """Digits of x - middle; taken digit by digit, so that no difference has to fit in 64 bits."""
    own, other = digits_of(x), digits_of(middle[None, :])
    zero = np.zeros((1, x.shape[1]))
    return [(own[k] if k < len(own) else zero) - (other[k] if k < len(other) else zero) for k in range(max(len(own), len(other)))]


def digit_products(blocks: Iterator[np.ndarray], middle: np.ndarray) -> Iterator[dict[tuple[int, int], np.ndarray]]:
    """Sums of (x - middle)(x - middle)' by the digits' places, as 64-bit integers; a new one after every FLUSH blocks."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    held = 0
    for x in blocks:
        for k in range(0, len(x), BLOCK):
            digits = centred_digits(x[k : k + BLOCK], middle)
            digits = [d if len(d) == len(x[k : k + BLOCK]) else np.repeat(d, len(x[k : k + BLOCK]), axis=0) for d in digits]
            for a, left in enumerate(digits):
                for b, right in enumerate(digits):
                    product = (left.T @ right).astype(np.int64)
                    sums[a, b] = sums[a, b] + product if (a, b) in sums else product
            held += 1
            if held == FLUSH:
                yield sums
                sums, held = {}, 0
    if held:
        yield sums


@dataclass
class Whitening:
    """What is fitted: rows n, per-dimension sums, the rounded mean, unit eigenvectors (dims, k), eigenvalues and their share of the trace.

    A component whose eigenvalue is zero, but for rounding, has NaN there.
    """

    n: int
    dims: int
    sums: list[int]
    middle: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centre(self) -> np.ndarray:
        """S/n - middle, rounded once from the exact fraction."""
        return np.array([float(Fraction(s - self.n * m, self.n)) for s, m in zip(self.sums, self.middle.tolist())])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows (rows, k), NaN in components without variance."""
        centred = sum(d * float(1 << (DIGIT_BITS * k)) for k, d in enumerate(centred_digits(x, self.middle))) - self.centre()
        with np.errstate(invalid="ignore", divide="ignore"):
            return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)**2, exact; None beyond 64 bits."""
        far = max((abs(self.n * v - s) for s, *two in zip(self.sums, x.min(axis=0).tolist(), x.max(axis=0).tolist()) for v in two), default=0) if len(x) else 0
        if far * far * max(self.dims, 1) < 1 << 62 and self.n * int(np.abs(x).max(initial=0)) < 1 << 62:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        found = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in found]


def eigen(n: int, sums: list[int], middle: np.ndarray, gram: list[list[int]], most: int = COMPONENTS) -> Whitening:
    """From exact sums and the exact product of entries less ``middle``: each covariance entry is rounded once, then the eigenvectors are taken."""
    d = len(sums)
    off = [s - n * m for s, m in zip(sums, middle.tolist())]
    exact = [[n * gram[i][j] - off[i] * off[j] for j in range(d)] for i in range(d)]
    trace = Fraction(sum(exact[i][i] for i in range(d)), n * n)
    # The whole matrix is taken as a multiple of its largest entry, so that no entry is too large or small for a double.
    unit = max((abs(v) for row in exact for v in row), default=0) or 1
    values, vectors = np.linalg.eigh(np.array([[float(Fraction(v, unit)) for v in row] for row in exact]).reshape(d, d))
    k = min(most, d)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0) if k else vectors
    scale = float(Fraction(unit, n * n))
    real = values > d * np.finfo(float).eps * max(values[0], 0) if k and trace else np.zeros(k, bool)
    own = np.where(real, values, np.nan) * scale
    return Whitening(n, d, sums, middle, vectors, own, np.where(real, own, 0.0) / float(trace) if trace else np.full(k, np.nan))


def steps_of(vector: Column) -> Column:
    """Entries as whole steps; null where the vector is null or holds a null or non-finite entry. Beyond 64 bits: the largest or least."""
    value = vector.cast("array<double>")
    odd = F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(value.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(value, lambda c: F.floor(F.lit(float(STEPS)) * c).cast("bigint")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """Rows of a partition in blocks of about BLOCK."""
    held, n = [], 0
    for b in batches:
        held.append(_matrix(b.column(0), dims))
        n += len(held[-1])
        if n >= BLOCK:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _digit_sums(cells: np.ndarray, place: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(np.full(len(cells), place, np.int32)), pa.array(values)], names=["cell", "place", "value"])


def _summed(digits: DataFrame) -> dict[int, int]:
    """Big integers by cell from digit sums of all tasks; there are as many cells as a matrix of two dimensions has."""
    found: dict[int, int] = {}
    for cell, place, value in digits.groupBy("cell", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found[cell] = found.get(cell, 0) + (int(value) << (DIGIT_BITS * place))
    return found


DIGIT_SUMS = "cell bigint, place int, value bigint"


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, dims):
            yield _digit_sums(np.array([-1]), 0, np.array([len(x)]))
            for place, d in enumerate(digits_of(x)):
                yield _digit_sums(np.arange(dims), place, d.sum(axis=0).astype(np.int64))

    found = _summed(fit.mapInArrow(each, DIGIT_SUMS))
    return found.get(-1, 0), [found.get(k, 0) for k in range(dims)]


def _gram(fit: DataFrame, dims: int, middle: np.ndarray) -> list[list[int]]:
    """The exact product of the fit list's entries less ``middle``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(dims)
        for sums in digit_products(_blocks(batches, dims), middle):
            for (a, b), product in sums.items():
                yield _digit_sums(i * dims + j, a + b, product[i, j])

    found = _summed(fit.mapInArrow(each, DIGIT_SUMS))
    return [[found.get(min(i, j) * dims + max(i, j), 0) for j in range(dims)] for i in range(dims)]


def fitted(fit: DataFrame, dims: int, most: int = COMPONENTS) -> Whitening | None:
    """Whitening from ``fit`` (x: array<bigint>, each vector once, all of ``dims`` entries); None without rows."""
    n, sums = _sums(fit, dims)
    if not n:
        return None
    middle = np.array([min(max(round(Fraction(s, n)), -(1 << 63)), (1 << 63) - 1) for s in sums], dtype=np.int64)
    return eigen(n, sums, middle, _gram(fit, dims, middle), most)


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance, centred, less the identity; over components with variance. None without any."""
    use = np.flatnonzero(np.isfinite(w.values)).tolist()
    if not use:
        return None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([w.project(_matrix(b.column(0), w.dims))[:, use], np.ones((b.num_rows, 1))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([(z.T @ z).ravel().tolist()])], names=["s"])

    width = len(use) + 1
    row = fit.mapInArrow(each, "s array<double>").agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width * width)]).first()
    sums = np.array(row, dtype=float).reshape(width, width)
    mean = sums[:-1, -1] / w.n
    return float(np.abs(sums[:-1, :-1] / w.n - np.outer(mean, mean) - np.eye(len(use))).max())


def whitened(embeddings: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Rows whose vector is null or holds a null or non-finite entry are left
    out. The fit list is each distinct vector of whole steps once. Vectors
    should be of one length; where they are not, the commonest (of those the
    longest) is fitted, and rows of another length get a row for each
    component with null figures. Without variance in a component (one row, or
    equal ones) whitened is null and explained 0, or null where there is none
    at all. deviation is null beyond 64 bits. Repeated rows each get their
    rows; other columns are left out; an empty table, or vectors without
    entries, give an empty result. The sign of a component makes its largest
    entry positive. vec_id must be a whole number.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    shape = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    own = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), steps_of(F.col(vector)).alias("x")).where("x is not null")
    lists = scratch.put(own.select("x").distinct())
    lengths = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not lengths or not lengths["d"]:
        return spark.createDataFrame([], shape)
    dims = lengths["d"]
    fit = lists.where(F.size("x") == dims)
    w = fitted(fit, dims, most)
    error = identity_error(fit, w)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for b in batches:
            here = b.column(1).value_lengths().to_numpy() == dims
            x = _matrix(b.column(1).filter(pa.array(here)), dims)
            z, deviation = np.full((b.num_rows, k), np.nan), np.full(b.num_rows, None)
            z[here], deviation[here] = w.project(x), w.deviations(x)
            repeat = lambda v: np.repeat(v, k)
            share = np.tile(w.explained, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(repeat(np.arange(b.num_rows)))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(b.num_rows * k, w.n)), pa.array(repeat(deviation).tolist(), pa.int64()),
                    pa.array(z.ravel(), mask=np.isnan(z.ravel())), pa.array(share, mask=np.isnan(share)), pa.array([error] * (b.num_rows * k), pa.float64()),
                ],
                names=[c.split()[0] for c in shape.split(", ")],
            )

    return own.mapInArrow(each, shape)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
