"""Runs of numbers moved between tasks as compressed blobs.

Rows of hashes cost most of a shuffle in their row format. A task that has
many at once sorts them, cuts them by the partition that they go to, and sends
one blob for each: byte planes of the columns, the first as differences.
Spark moves (part, kind, blob) rows and knows nothing else of them; a lost task is
run again like any other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

SHAPE = "part int, kind int, blob binary"
#: Rows of numbers that a partition should hold, so that it fits in a worker's memory whatever the corpus' size.
PART_ROWS = 4_000_000

squeezed = zstandard.ZstdCompressor(level=1).compress
opened = zstandard.ZstdDecompressor().decompress


def parts_for(spark: SparkSession, rows: int = 0) -> int:
    """Partitions for so many rows: those set for shuffles at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Which partition a 64-bit hash goes to; all rows of a key go to one."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length and 1 to 8 bytes a value; the first, which should be nearly sorted, is kept as differences."""
    n = len(columns[0])
    first = columns[0].view(np.uint64).copy()
    first[1:] -= columns[0].view(np.uint64)[:-1]
    made = [struct.pack("<QB", n, len(columns))]
    for k, c in enumerate((first, *columns[1:])):
        made.append(columns[k].dtype.str.encode().ljust(4))
        made.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T).tobytes())
    return squeezed(b"".join(made))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = opened(blob)
    n, columns = struct.unpack_from("<QB", data)
    at, out = 9, []
    for k in range(columns):
        kind = np.dtype(data[at : at + 4].decode().strip())
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at + 4).reshape(kind.itemsize, n)
        c = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        out.append(np.cumsum(c, dtype=np.uint64).view(kind) if k == 0 else c)
        at += 4 + n * kind.itemsize
    return out


def dealt(part: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One blob for each part, the rows of a part in order of the upper bits of the first column."""
    bits = np.uint64(max(int(part.max(initial=0)).bit_length(), 1))
    order = np.argsort((part.astype(np.uint64) << (np.uint64(64) - bits)) | (columns[0].astype(np.uint64) >> bits))
    part, columns = part[order], [c[order] for c in columns]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield int(part[a]), kind, pack(*(c[a:b] for c in columns))


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, kinds, blobs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


def batches_of(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
    """The columns of each kind from all blobs of a partition."""
    found: dict[int, list[list[np.ndarray]]] = {}
    for b in batches:
        for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            found.setdefault(kind, []).append(unpack(blob))
    return {kind: [np.concatenate(c) for c in zip(*rows)] for kind, rows in found.items()}


def met(df: DataFrame, parts: int) -> DataFrame:
    """Blobs brought together by their part; parts are hashes cut evenly, so each is of like size."""
    return df.repartitionById(parts, "part")
