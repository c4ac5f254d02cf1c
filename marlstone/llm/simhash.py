"""Near-duplicates.

op3_simhash_dedup: SimHash fingerprints, pigeonhole blocks, then a check of the Hamming distance.
The pipeline's stage: fingerprints of five words, the same blocks and distance check, then a check of the exact similarity;
pairs as similar whose fingerprints lie further apart are met through rare shingles, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import Scratch, bounded_batches, table, text_key
from .components import components
from .hashing import batch_words, mixed, pair_hashes

#: Seed of the shingle hash.
SEED = 42
#: A block of more fingerprints than this is split again by the bits outside it.
SPLIT_ROWS = 4096

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """64 bits; bit i is set where over half of the shingle hashes, repeats included, have it. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > len(hashes)).tolist()))


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp bigint, _k1, _k2) for every row; the last two stand for its text. A null text counts as empty."""
    bounded_batches(documents.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint_of(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2), b.column(3)], names=["doc_id", "fp", "_k1", "_k2"])

    return documents.select(F.col("doc_id").cast("bigint"), "text", *text_key(F.col("text"))).mapInArrow(each, "doc_id bigint, fp bigint, _k1 bigint, _k2 int")


def blocks_for(distance: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks (shift, width) of the 64 bits and how many of them make a key.

    With ``distance + 2`` blocks, two fingerprints that differ in at most
    ``distance`` bits agree in two blocks at least, so keys of two blocks lose no pair.
    """
    n = distance + 2
    cuts = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], 2


def links(classes: DataFrame, scratch: Scratch, distance: int = 2) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect just what links at ``distance`` or fewer bits.

    ``classes`` has a column fp without repeats. Every fingerprint goes to one
    block for each pair of bit ranges, one of more than SPLIT_ROWS to finer ones; a task reads its blocks in order and
    emits a spanning forest of each, at most one edge for each member, not its pairs.
    """
    ranges, take = blocks_for(distance)
    keys, finer = [], []
    for k, chosen in enumerate(combinations(ranges, take)):
        key = F.lit(k).cast("bigint")
        for shift, width in chosen:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
        rest = [i for x in ranges if x not in chosen for i in range(x[0], x[0] + x[1])]
        masks = np.array([sum(1 << int(i) for i in part) for part in np.array_split(rest, distance + 1)], dtype=np.uint64).view(np.int64)
        finer.append(F.array(*[F.xxhash64(F.lit(k), F.lit(j), key, F.col("fp").bitwiseAND(F.lit(int(m)))) for j, m in enumerate(masks)]))
    bounded_batches(classes.sparkSession)
    rows = classes.select("fp", F.posexplode(F.array(*keys)).alias("block", "key"))
    large = scratch.put(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS).select("key"))
    if large.head(1):
        # Members of a block differ in its other bits alone: near ones agree in one of ``distance + 1`` parts of those, so none is lost where they are dealt out by each part.
        split = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
        parts = F.get(F.array(*finer), F.col("block"))
        rows = rows.join(split, "key", "left_anti").select("fp", "key").union(rows.join(split, "key", "left_semi").select("fp", F.explode(parts).alias("key")))
    rows = rows.select("fp", "key").repartition("key").sortWithinPartitions("key", "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            key, fp = b.column(1).to_numpy(), b.column(0).to_numpy()
            if held and len(key) and key[-1] == held[0][0][-1] and key[0] == key[-1]:
                held.append((key, fp))  # one block goes on through this whole batch
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held, (key, fp)))
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            yield from _forest(keys[:last], fps[:last], distance)
            held = [(keys[last:], fps[last:])] if len(keys) else []
        if held:
            keys, fps = (np.concatenate(x) for x in zip(*held))
            yield from _forest(keys, fps, distance)

    return rows.mapInArrow(each, "a bigint, b bigint").distinct()


def _forest(keys: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    edges: list[tuple[int, int]] = []
    for k in np.flatnonzero(ends - starts > 1).tolist():
        edges += spanning(fps[starts[k] : ends[k]].view(np.uint64), distance)
    if edges:
        out = np.array(edges, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a forest over the fingerprints; the trees are what links within the group.

    A large group is split by ``distance + 1`` ranges of the bits in which its
    members differ: near pairs agree in one of them, so none is lost.
    """
    if len(fps) > SPLIT_ROWS:
        varying = [i for i in range(64) if np.any((fps ^ fps[0]) >> np.uint64(i) & np.uint64(1))]
        if len(varying) >= 8 * (distance + 1):
            edges = []
            for part in np.array_split(np.array(varying), distance + 1):
                own = fps & np.uint64(sum(1 << int(i) for i in part))
                order = np.argsort(own, kind="stable")
                for group in np.split(fps[order], np.flatnonzero(np.diff(own[order])) + 1):
                    if 1 < len(group) < len(fps):
                        edges += spanning(group, distance)
                    elif len(group) == len(fps):
                        edges += _grow(group, distance)
            return edges
    return _grow(fps, distance)


def _grow(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    rest, queue, edges = fps, [], []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        near = np.bitwise_count(rest ^ at) <= distance
        if near.any():
            found = rest[near]
            edges += [(int(at), int(x)) for x in found]
            queue += list(found)
            rest = rest[~near]
    return edges


def fingerprint_groups(documents: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, component, _k1, _k2): groups of documents linked by near fingerprints.

    Rows with equal fingerprints are collapsed before anything is compared,
    so copies cost one comparison. component_id is the smallest doc_id
    reachable, null only where no member has one. Texts that are null, empty
    or all white space share fingerprint zero and link like others; repeated
    rows each get a row. Other columns are left out; an empty table gives an
    empty result.
    """
    scratch = Scratch(documents.sparkSession)
    own = scratch.put(fingerprints(documents, shingle))
    classes = scratch.put(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _grouped(own, classes, links(classes.select("fp"), scratch, distance), scratch).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def _grouped(own: DataFrame, classes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``own`` (doc_id, fp, _k1, _k2) with component and component_id, from the edges among distinct fp; ``classes`` has each fp once, with its least doc_id."""
    linked = components(edges, scratch)
    named = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # Written out, so that a component's members are met through a shuffle whose large partitions can be split.
    first = scratch.put(named.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = named.join(first, "component").select("fp", "component", "component_id")
    return own.join(ids, "fp")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: Ids of at most this many dropped rows may be broadcast.
BROADCAST_ROWS = 500_000
#: Words of a shingle in the pipeline's stage.
WORDS = 5
#: Two texts are near-duplicates if their sets of shingles have this similarity (Jaccard), as a fraction.
SIMILAR = (4, 5)
#: Fingerprints of WORDS words that differ in so many bits or fewer make a pair to check.
NEAR_BITS = 3
#: Shingles are ordered by how often their cell of 2**CELL_BITS occurs, then by hash; any order would do, this one leaves the common ones aside.
CELL_BITS = 20
#: Shingles of a cell with so many are dealt out by text as well, as one of them may be in a large part of all texts.
HOT_CELL = 1_000_000
#: Rows that a task adds up before it sends them.
HELD = 1_000_000
#: A shingle that more sets have among their first is not paired off: its sets are compared in blocks of BLOCK_SETS, held by a task, with chunks of CHUNK_SETS that pass by.
HOT_KEY, BLOCK_SETS, CHUNK_SETS = 128, 4096, 50_000


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted set of hashes of WORDS words in a row; a shorter text is one shingle, a text without words has none."""
    hashes, n = batch_words(column)
    ends = np.cumsum(n)
    long = hashes
    for _ in range(min(WORDS - 1, max(len(hashes) - 1, 0))):
        long = pair_hashes(long)
    out = []
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        if b - a >= WORDS:
            out.append(np.unique(long[a : b - WORDS + 1]))
        else:
            h = hashes[a:b]
            while len(h) > 1:
                h = pair_hashes(h)
            out.append(h)
    return out


def _class(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _over_texts(documents: DataFrame, make, shape: str) -> DataFrame:
    """Rows that ``make`` gives, as columns, for a batch's sets of shingles."""
    bounded_batches(documents.sparkSession)
    names = [x.split()[0] for x in shape.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(make(sets_of(b.column(0)), b), names=names)

    return documents.mapInArrow(each, shape)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _ranges(documents: DataFrame) -> DataFrame:
    """(cell, n): a row for each partition, its first cell and how many texts' shingles fall in that and each that follows, compressed."""
    bounded_batches(documents.sparkSession)
    parts = blobs.parts_for(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            n += np.bincount(_cells(np.concatenate([np.empty(0, np.uint64), *sets_of(b.column(0))])), minlength=len(n))
        at = np.flatnonzero(n)
        key = at.astype(np.uint64) << np.uint64(64 - CELL_BITS)
        yield from blobs.batches_of(blobs.dealt(blobs.part_of(key, parts), 0, key, n[at]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = blobs.gathered(batches)
        if found:
            cells, counts = _cells(found[0][0]), found[0][1]
            n = np.zeros(cells.max() - cells.min() + 1, np.int64)
            np.add.at(n, cells - cells.min(), counts)
            n = np.minimum(n, (1 << 32) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([cells.min()]), pa.array([blobs.squeezed(n.tobytes())], pa.binary())], names=["cell", "n"])

    return blobs.met(documents.select("text").mapInArrow(count, blobs.SHAPE), parts).mapInArrow(add, "cell bigint, n binary")


def _counted(documents: DataFrame) -> np.ndarray:
    """How many texts' shingles fall in each cell. The array's size is fixed; a short row for each partition reaches the driver, not one for each cell."""
    out = np.zeros(1 << CELL_BITS, np.uint32)
    for at, n in _ranges(documents).collect():
        n = np.frombuffer(blobs.opened(bytes(n)), np.uint32)
        out[at : at + len(n)] += n
    return out


def _members(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, fp, size, place): the first shingles of each set that another set has among its first too.

    A set is named by its hash. A task sends each of its sets once; shingles of hot cells are dealt out by set and all kept.
    """
    few, of = SIMILAR
    bounded_batches(documents.sparkSession)
    parts, most, hot = blobs.parts_for(documents.sparkSession), HELD, HOT_CELL
    held_counts = documents.sparkSession.sparkContext.broadcast(counts)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, seen = [], 0, set()
        counts = held_counts.value

        def sent() -> Iterator[pa.RecordBatch]:
            key, fp, size, place = (np.concatenate(c) for c in zip(*held))
            to = np.where(counts[_cells(key)] >= hot, blobs.part_of(mixed(key ^ fp), parts), blobs.part_of(key, parts))
            return blobs.batches_of(blobs.dealt(to, 0, key, fp, size, place))

        for b in batches:
            for s in sets_of(b.column(0)):
                fp = _class(s)
                if len(s) and fp not in seen:
                    seen.add(fp)
                    first = s[np.lexsort((s, counts[_cells(s)]))][: len(s) + few * -len(s) // of + 1]
                    held.append((first, np.full(len(first), fp, np.uint64), np.full(len(first), len(s), np.uint32), np.arange(len(first), dtype=np.uint32)))
                    rows += len(first)
            if rows > most:
                yield from sent()
                held, rows, seen = [], 0, set()
        if rows:
            yield from sent()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = blobs.gathered(batches)
        if not found:
            return
        counts = held_counts.value
        order = np.lexsort((found[0][1], found[0][0]))
        key, fp, size, place = (c[order] for c in found[0])
        new = np.concatenate(([True], key[1:] != key[:-1]))
        once = new | np.concatenate(([True], fp[1:] != fp[:-1]))
        key, fp, size, place = (c[once] for c in (key, fp, size, place))
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(new, len(key)))
        kept = (np.repeat(n, n) > 1) | (counts[_cells(key)] >= hot)
        out = [x[kept].astype(t).view(np.int64) for x, t in ((key, np.uint64), (fp, np.uint64), (size, np.int64), (place, np.int64))]
        for k in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in out], names=["key", "fp", "size", "place"])

    return blobs.met(documents.select("text").mapInArrow(firsts, blobs.SHAPE), parts).mapInArrow(shared, "key bigint, fp bigint, size bigint, place bigint")


def near_fingerprints(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of sets, by their hash, that a walk over all fingerprints within NEAR_BITS takes; of sets with one fingerprint, the least with each other.

    ``classes`` has (fp, sim) for each set: its hash and the fingerprint of one of its texts.
    """
    heads = scratch.put(classes.groupBy("sim").agg(F.min("fp").alias("head")))
    found = links(heads.select(F.col("sim").alias("fp")), scratch, NEAR_BITS)
    at = lambda end: heads.select(F.col("sim").alias(end), F.col("head").alias(f"head_{end}"))
    apart = found.join(at("a"), "a").join(at("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return apart.union(classes.join(heads, "sim").where("fp <> head").select("head", "fp"))


def similar(documents: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): edges between sets of shingles, by their hash, that connect just what links at SIMILAR or more.

    ``classes`` has (fp, sim, _k1, _k2) for each set: its hash, and the fingerprint and key of one of its texts. Pairs
    of near fingerprints are checked for their exact similarity. No number of bits is sure to hold all pairs, so the others are met
    through shingles: sets that similar share one of the first shingles of each in any order of
    all shingles, if the first are those beyond the least overlap, and one;
    so the members of a shared first shingle's group hold every pair. The least
    member of each group is compared with the others, which joins large
    groups of near copies; then every two that are not yet joined.
    """
    few, of = SIMILAR
    members = scratch.put(_members(documents, _counted(documents)))

    def sets_for(ids: DataFrame) -> DataFrame:
        """(fp, shingles) of the listed sets; texts of these alone are read, and a bounded list of them spares the others the shuffle."""
        wanted = scratch.put(classes.join(ids, "fp").select("_k1", "_k2"))
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        texts = documents.select("text", *text_key(F.col("text"))).join(wanted, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("text")
        return scratch.put(_over_texts(texts, lambda sets, b: [_signed([_class(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], "fp bigint, shingles array<bigint>"))

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = scratch.put(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        n = pairs.count()
        if not n:
            return pairs
        sent = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
        sets = sets_for(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
        others = sets.join(sent(pairs.select(F.col("a").alias("fp")).distinct()), "fp", "left_semi").select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
        both = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")).join(sent(pairs), "b").join(others, "a")
        common = F.size(F.array_intersect("x", "y"))
        out = scratch.put(both.where(of * common >= few * (F.size("x") + F.size("y") - common)).select("a", "b"))
        scratch.drop(sets)
        return out

    # Written out, so that the rows of a hot key can be split in the join.
    least = scratch.put(members.groupBy("key").agg(F.min(F.struct("fp", "size", "place")).alias("x")).select("key", F.col("x.fp").alias("fp_x"), F.col("x.size").alias("size_x"), F.col("x.place").alias("place_x")))
    overlap = F.least(F.col("size") - F.col("place"), F.col("size_x") - F.col("place_x"))
    fits = (of * F.least("size", "size_x") >= few * F.greatest("size", "size_x")) & ((few + of) * overlap >= few * (F.col("size") + F.col("size_x")))
    first = members.join(least, "key").where((F.col("fp") != F.col("fp_x")) & fits).select(F.col("fp_x").alias("a"), F.col("fp").alias("b"))
    linked = components(checked(near_fingerprints(classes, scratch).union(first)), scratch)
    edges = linked.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    rest = members.join(linked, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp")).drop("node")
    rest = scratch.put(rest)
    apart = scratch.put(rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n"))
    edges = edges.union(checked(_pairs(rest.join(apart.where(F.col("n") <= HOT_KEY), "key").drop("n"))))
    hot = apart.where(F.col("n") > HOT_KEY)
    if not hot.head(1):
        return edges
    hot_rows = scratch.put(rest.join(hot, "key").select("key", "fp", "component"))
    return edges.union(_links_in_blocks(hot_rows, sets_for, scratch))


def _links_in_blocks(rows: DataFrame, sets_for: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(a, b): links among the sets of each key of ``rows`` (key, fp, component) that join different components; a forest, not all links.

    Keys that share sets make one cluster. Its largest component is taken as joined;
    the other sets are cut into blocks, and each block is compared with all sets of the cluster, chunk by
    chunk: a task holds one block and an index of its shingles, and the chunk passes by.
    """
    least = scratch.put(rows.groupBy("key").agg(F.min("fp").alias("a")))
    linked = components(rows.join(least, "key").select("a", F.col("fp").alias("b")), scratch)
    own = scratch.put(rows.select("fp", "component").distinct().join(linked.select(F.col("node").alias("fp"), F.col("component").alias("cluster")), "fp"))
    sizes = own.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
    sizes = scratch.put(sizes.select("cluster", F.col("most.component").alias("joined"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK_SETS).cast("int").alias("blocks"), F.ceil(F.col("n") / CHUNK_SETS).cast("int").alias("chunks")))
    own = own.join(sizes, "cluster").where("blocks > 0")
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = own.where("component <> joined").select("cluster", place("blocks", 1).alias("block"), F.explode(every("chunks")).alias("chunk"), F.lit(0).alias("kind"), "fp", "component")
    passing = own.select("cluster", F.explode(every("blocks")).alias("block"), place("chunks", 2).alias("chunk"), F.lit(1).alias("kind"), "fp", "component")
    sets = sets_for(own.select("fp"))
    by = ["cluster", "block", "chunk", "kind"]
    dealt = held.union(passing).join(sets, "fp").select(*by, "fp", "component", "shingles").repartition(*by[:3]).sortWithinPartitions(*by)
    bounded_batches(rows.sparkSession)
    few, of = SIMILAR

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, index = None, [], None
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for b in batches:
            names = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            fps, of_component = b.column(4).to_pylist(), b.column(5).to_pylist()
            lists = b.column(6)
            flat, offsets = lists.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            edges = []
            for i, (*group, kind) in enumerate(names):
                if group != at:
                    at, block, index = group, [], None
                s = flat[offsets[i] : offsets[i + 1]]
                if kind == 0:
                    block.append((fps[i], of_component[i], s))
                    continue
                if index is None:
                    index = _Index([x[2] for x in block]) if block else False
                if not index:
                    continue
                common = index.common(s)
                near = np.flatnonzero(of * common >= few * (index.sizes + len(s) - common))
                for k in near.tolist():
                    x, y = root(block[k][1]), root(of_component[i])
                    if x != y:
                        parent[x] = y
                        edges.append((block[k][0], fps[i]))
            if edges:
                out = np.array(edges, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return scratch.put(dealt.mapInArrow(each, "a bigint, b bigint"))


class _Index:
    """Which of a block's sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, self.starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(self.starts, len(flat))

    def common(self, shingles: np.ndarray) -> np.ndarray:
        """How many of these shingles each set has."""
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        at = at[self.keys[at] == shingles]
        n = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(n) else 0) + np.repeat(self.starts[at] - (ends - n), n)
        return np.bincount(self.owners[places], minlength=len(self.sizes))


def _pairs(members: DataFrame) -> DataFrame:
    """(a, b) within each key, of different components and with sizes and places that allow SIMILAR.

    If the key is the first that two sets share, they share at most what comes after it in both; so a pair passes at its first shared key.
    The members outside a key's largest component are each compared with all.
    """
    few, of = SIMILAR
    rows = members.select("key", "fp", "size", "place", "component").repartition("key").sortWithinPartitions("key", "component", "fp")

    def within(fp: np.ndarray, size: np.ndarray, place: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate(([True], component[1:] != component[:-1])))
        n = np.diff(np.append(starts, len(fp)))
        largest = component[starts[np.argmax(n)]]
        for k in np.flatnonzero(component != largest).tolist():
            ok = (component != component[k]) & (of * np.minimum(size, size[k]) >= few * np.maximum(size, size[k]))
            ok &= (few + of) * np.minimum(size - place, size[k] - place[k]) >= few * (size + size[k])
            other = fp[ok]
            if len(other):
                yield np.minimum(other, fp[k]), np.maximum(other, fp[k])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, n = [], [], 0

        def groups(last: bool):
            nonlocal held
            key, *rest = (np.concatenate(x) for x in zip(*held))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[: None if last else -1], cuts[1 : None if last else -1]):
                yield from within(*(x[a:b] for x in rest))
            held = [] if last else [[x[cuts[-2] :] for x in (key, *rest)]]

        def sent():
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*out)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            own = [b.column(k).to_numpy() for k in range(5)]
            goes_on = held and own[0][-1] == held[0][0][-1]
            held.append(own)
            if goes_on:
                continue
            for pair in groups(False):
                out.append(pair)
                n += len(pair[0])
                if n > 100_000:
                    yield sent()
                    out, n = [], 0
        if held:
            for pair in groups(True):
                out.append(pair)
                n += len(pair[0])
                if n > 100_000:
                    yield sent()
                    out, n = [], 0
        if out:
            yield sent()

    return rows.mapInArrow(each, "a bigint, b bigint")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component, component_id, _k1, _k2) for every row: groups of documents linked at SIMILAR or more.

    Texts of the same shingles are one class, so copies cost one comparison;
    texts that are null, empty or all white space are a class of their own.
    """
    scratch = Scratch(documents.sparkSession)
    own = documents.select("text", F.col("doc_id").cast("bigint").alias("doc_id"), *text_key(F.col("text")))

    def made(sets: list[np.ndarray], b: pa.RecordBatch) -> list[pa.Array]:
        prints = [fingerprint_of(t or b"", WORDS) for t in b.column(0).cast(pa.binary()).to_pylist()]
        return [b.column(1), _signed([_class(s) for s in sets]), _signed(prints), b.column(2), b.column(3)]

    own = scratch.put(_over_texts(own, made, "doc_id bigint, fp bigint, sim bigint, _k1 bigint, _k2 int"))
    classes = scratch.put(own.groupBy("fp").agg(F.min(F.struct("_k1", "_k2", "sim")).alias("k"), F.min("doc_id").alias("least")).select("fp", "k.*", "least"))
    return _grouped(own.drop("sim"), classes, similar(documents, classes.drop("least"), scratch), scratch)


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """``documents`` with one row for each group of near-duplicates.

    The row with the group's smallest doc_id stays (a null one only where no
    member has an id); of rows with that id but other texts, one, and of
    rows that repeat it whole, one. What goes is found from ids and hashes
    alone; the texts are read once more to leave it out. Other columns may have any names.
    """
    scratch = Scratch(documents.sparkSession)
    key = ["doc_id", "_k1", "_k2"]
    rows = scratch.put(near_duplicates(documents).groupBy("component", *key).agg(F.count("*").alias("n")))
    least = scratch.put(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *key)).alias("least")))
    marked = scratch.put(rows.join(least, "component").select(*key, "n", F.struct(*key).eqNullSafe(F.struct(*[F.col(f"least.{k}").alias(k) for k in key])).alias("stays")))
    gone, twice = marked.where("not stays").select(*key), marked.where("stays and n > 1").select(*key)
    own = documents.select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), *text_key(F.col("text")))
    if not twice.head(1):
        return _without(own, gone, key).select("_row.*")
    single = _without(own, gone.union(twice), key)
    same = [own[k].eqNullSafe(twice[k]) for k in key]
    return single.unionByName(own.join(twice, same, "left_semi").dropDuplicates(key)).select("_row.*")


def _without(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return rows.join(keys, [rows[k].eqNullSafe(keys[k]) for k in key], "left_anti")
