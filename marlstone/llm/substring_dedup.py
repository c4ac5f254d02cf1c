"""Removal of byte strings that occur twice: sampled positions, names, comparison of what shares a name.

Positions are sampled by content (the least 32-byte tuple of each 200-byte
string, one position in 85), so equal strings are sampled alike. Samples are
named by a hash of their tuple, and strings are compared through the sample that covers
them, where its name occurs twice. No suffix is sorted: only equality of the
next 200 bytes is asked for. The README says why, with figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table, text_key

#: Bytes of a string that is removed where it repeats.
LENGTH = 200
#: Bytes of a sampled tuple.
TUPLE = 32
#: Starts handled at once; a longer text is worked through in pieces, whose cuts cost comparisons but change nothing.
PIECE = 1 << 20

_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """64-bit hashes of any substrings of one piece of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * _power(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def each(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def runs_of(text: bytes, length: int = LENGTH) -> list[np.ndarray]:
    """(name, context, first, last) of each sampled position: windows that start in first..last have it as their sample.

    A window's sample is its least tuple, the rightmost of equal ones, and
    so depends on the window's bytes alone. The context is the hash of all
    bytes that these windows cover and of where the sample lies in them.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    tuples = length - TUPLE + 1
    names, contexts, firsts, lasts = [], [], [], []
    for at in range(0, len(data) - length + 1, PIECE):
        h = Hasher(data[at : at + PIECE + length - 1])
        n = len(h.sums) - 1 - TUPLE + 1
        full = h.each(slice(0, n), slice(TUPLE, TUPLE + n))
        packed = (full & ~_POS_MASK) | (_POS_MASK - np.arange(n, dtype=np.uint64))
        sample = (_POS_MASK - (_sliding_min(packed, tuples) & _POS_MASK)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(sample)) + 1
        first = np.concatenate(([0], cuts))
        last = np.concatenate((cuts, [len(sample)])) - 1
        p = sample[first]
        context = h.each(first, last + length)
        shape = (p - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
        name = full[p]
        names.append(name)
        contexts.append(_mix(context + _mix(shape + name)))
        firsts.append(first + at)
        lasts.append(last + at)
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (names, contexts, firsts, lasts)]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


_RUNS = "name bigint, context bigint, _k1 bigint, _k2 int, first int, last int"


def runs(texts: DataFrame, length: int) -> DataFrame:
    """The runs of every text of ``texts`` (text, _k1, _k2)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            made, k = [], []
            for i, text in enumerate(b.column(0).cast(pa.binary()).to_pylist()):
                if text and len(text) >= length:
                    made.append(runs_of(text, length))
                    k.append(i)
            if made:
                sizes = [len(x[0]) for x in made]
                name, context, first, last = (np.concatenate(x) for x in zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [_signed(name), _signed(context), pa.array(np.repeat(k1[k], sizes)), pa.array(np.repeat(k2[k], sizes)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    names=["name", "context", "_k1", "_k2", "first", "last"],
                )

    return texts.where(F.octet_length("text") >= length).select("text", "_k1", "_k2").mapInArrow(each, _RUNS)


def packed(documents: DataFrame) -> DataFrame:
    """(doc_id, _k1, _k2, z) with texts compressed, for the two joins that move them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            z = [squeeze(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(z, pa.binary())], names=["doc_id", "_k1", "_k2", "z"])

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *text_key(F.col("text")))
    return own.mapInArrow(each, "doc_id bigint, _k1 bigint, _k2 int, z binary")


def surroundings(held: DataFrame, length: int) -> DataFrame:
    """(name, context, twice, bytes): what the listed runs cover, from (z, _k1, _k2, listed); equal texts in a task speak once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        seen: set = set()
        for b in batches:
            out = []
            for z, k1, k2, listed in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (k1, k2) not in seen:
                    seen.add((k1, k2))
                    text = open_(z)
                    out += [(x["name"], x["context"], x["n"] > 1, text[x["first"] : x["last"] + length]) for x in listed]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["name", "context", "twice", "bytes"])

    return held.select("z", "_k1", "_k2", "listed").mapInArrow(each, "name bigint, context bigint, twice boolean, bytes binary")


def _window_hashes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text, offset) of every window of every text."""
    hashes, sizes = [], []
    for text in texts:
        n = len(text) - length + 1
        hashes.append(Hasher(np.frombuffer(text, dtype=np.uint8)).each(slice(0, n), slice(length, length + n)))
        sizes.append(n)
    offsets = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    return np.concatenate(hashes), np.repeat(np.arange(len(texts)), sizes), offsets


def single_by_group(rows: DataFrame, length: int) -> DataFrame:
    """(context, single): offsets of windows that occur once, comparing the contexts of a name with each other where they meet."""

    def compared(held: list[tuple]) -> pa.RecordBatch:
        by_context = {c: (c, twice, text) for _, c, twice, text in held}  # equal rows from copies of a text count once
        contexts, twice, texts = zip(*by_context.values())
        window, index, offset = _window_hashes(list(texts), length)
        _, back, n = np.unique(window, return_inverse=True, return_counts=True)
        alone = (n[back] == 1) & ~np.array(twice)[index]
        cuts, chosen = np.searchsorted(index[alone], np.arange(len(texts) + 1)), offset[alone]
        parts = [chosen[a:b] for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(contexts, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["context", "single"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            rows = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            held += rows
            if held[0][0] != rows[-1][0]:
                last = rows[-1][0]
                yield compared([r for r in held if r[0] != last])
                held = [r for r in held if r[0] == last]
        if held:
            yield compared(held)

    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(each, "context bigint, single array<int>")


def single_by_window(rows: DataFrame, length: int) -> DataFrame:
    """The same for names with very many contexts: windows are counted by hash, so that no task holds a name's contexts together."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, contexts, twice, texts = (b.column(k).to_pylist() for k in range(4))
            window, index, offset = _window_hashes(texts, length)
            yield pa.RecordBatch.from_arrays([_signed(window), pa.array(np.array(contexts)[index]), pa.array(offset), pa.array(np.array(twice)[index])], names=["window", "context", "off", "twice"])

    one = F.struct("context", "off")
    made = rows.mapInArrow(each, "window bigint, context bigint, off int, twice boolean")
    counted = made.groupBy("window").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.max("twice").alias("twice"))
    return counted.where("a = b and not twice").groupBy("a.context").agg(F.sort_array(F.collect_list("a.off")).alias("single"))


def removed_bytes(text: bytes, listed: list[dict], length: int = LENGTH) -> np.ndarray:
    """True at each byte that a repeated window covers; listed: first, last and the offsets of windows that do not repeat."""
    steps = np.zeros(len(text) + 1, dtype=np.int64)
    for x in listed:
        starts = np.arange(x["first"], x["last"] + 1)
        if x["single"]:
            starts = np.delete(starts, x["single"])
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


#: Names with more contexts than this are compared window by window over all machines.
MANY = 2_000


def repeated_runs(documents: DataFrame, texts: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(_k1, _k2, runs: array of (first, last, single)) for each text that has a repeated window.

    Runs with a name that occurs once cannot repeat and are left out. Where
    all runs of a name have one context, their windows repeat without being
    looked at. Where contexts differ, each different one is written out once
    and its windows are compared; what comes back are the windows that occur
    once. So copies cost one row each, however many there are.
    """
    own = runs(documents.select("text", *text_key(F.col("text"))), length)
    # Written out, it meets the runs through a shuffle of its own, whose large partitions can be split; a name may hold a third of all runs.
    often = scratch.put(own.groupBy("name").count().where("count > 1").select("name"))
    hits = scratch.put(own.join(often, "name", "left_semi"))
    contexts = scratch.put(hits.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2", "first", "last")).alias("o")))
    groups = contexts.groupBy("name").agg(F.count("*").alias("many")).where("many > 1")
    varied = contexts.join(groups, "name")

    def rows_of(chosen: DataFrame) -> DataFrame:
        item = F.struct("name", "context", "n", F.col("o.first").alias("first"), F.col("o.last").alias("last"))
        listed = chosen.groupBy(F.col("o._k1").alias("_k1"), F.col("o._k2").alias("_k2")).agg(F.collect_list(item).alias("listed"))
        return surroundings(texts.join(listed, ["_k1", "_k2"]), length)

    single = single_by_group(rows_of(varied.where(F.col("many") <= MANY)), length)
    if groups.where(F.col("many") > MANY).head(1):
        single = single.union(single_by_window(rows_of(varied.where(F.col("many") > MANY)), length))
    single = single.where("size(single) > 0")
    named = hits.join(single, "context", "left").where("single is null or size(single) <= last - first")
    run = F.struct("first", "last", F.coalesce("single", F.array().cast("array<int>")).alias("single"))
    return named.groupBy("_k1", "_k2").agg(F.collect_set(run).alias("runs"))


def deduplicated(documents: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    A byte goes if any ``length``-byte string that covers it also starts
    somewhere else, in the same text or another; so every copy goes. Texts
    that are null count as empty; repeated rows remove each other if they
    have ``length`` bytes. ``kept`` is the remaining bytes, null if not asked for.
    """
    bounded_batches(documents.sparkSession)
    texts = packed(documents)
    found = repeated_runs(documents, texts, Scratch(documents.sparkSession), length)
    joined = texts.join(found, ["_k1", "_k2"], "left").select("doc_id", "z", "runs")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for z, listed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = open_(z)
                gone = removed_bytes(text, listed, length) if listed else np.zeros(len(text), bool)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1))
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(each, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
