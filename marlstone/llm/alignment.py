"""Cross-tokenizer alignment: groups of tokens of two tokenizers over the same bytes, and counts of the id pairs that they link.

A task encodes its texts with both tokenizers. Tokens whose byte ranges overlap
are the edges of a two-sided graph; union-find over them gives its connected
components, which are exactly the minimal groups. Equal words are aligned once. Within a group, tokens
whose ranges end together are linked. Each text keeps its links as one compressed blob
of id pairs; pairs are counted per task, then by Spark over all texts, and each
text looks its pairs up again: common pairs in a bounded table that every task holds, the others by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import Scratch, bounded_batches, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs that are sent to every task, 20 bytes each; the others are joined.
SENT = 1_000_000
#: Links that a task gathers before it counts them, and different pairs that it holds before it sends them on.
GATHERED, HELD = 4_000_000, 1_000_000
#: Characters of texts that are aligned at once; a longer text is aligned by itself.
CHUNK = 2_000_000
#: Units, and characters of them, that a worker keeps between texts; beyond either it begins anew.
KEPT_UNITS, KEPT_CHARACTERS = 500_000, 16_000_000
#: From so many characters on, a text is encoded by the slower library, which has no bound on a run of white space; the ids are the same.
LONG_TEXT = 200_000
#: The splitting rule of the byte-level model: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NUMBERS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Tokenizer A: a byte-level BPE file. Strings of special tokens are plain text."""

    def __init__(self, data: str):
        import tiktoken
        from tokenizers import Tokenizer

        held = json.loads(data)["model"]
        values = byte_values()
        self.octets = [b""] * (max(held["vocab"].values()) + 1)
        for token, i in held["vocab"].items():
            self.octets[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        self.slow = Tokenizer.from_str(data)
        self.slow.encode_special_tokens = True
        # Where merges stand in the order of the ids that they make, the quicker library's ranks are these ids.
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in held["merges"]]
        ranked = all(held["vocab"].get(m) == 256 + k for k, m in enumerate(merged))
        ranks = {self.octets[i]: i for i in range(256 + len(merged))} if ranked else {}
        self.quick = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merged) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for t in texts:
            quick = self.quick is not None and len(t) < LONG_TEXT
            out.append(self.quick.encode_ordinary(t) if quick else self.slow.encode(t, add_special_tokens=False).ids)
        return out


class PieceTokenizer:
    """Tokenizer B: a SentencePiece file."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_proto=data)
        size = self.own.get_piece_size()
        self.octets = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.own.id_to_piece, range(size)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers, how their tokens are written, and the units aligned so far.

    A unit is a space and what follows it up to the next one. Neither
    tokenizer has a token across the bounds that ``units`` cuts at, so both
    have token ends there, no group crosses them, and equal units are aligned once.
    """

    #: Where a cut would part a token, within a run of spaces or at a space between other white space, or leave an empty unit at the end.
    UNCUT = re.compile(r"  |\s \s| \Z")

    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteTokenizer(a), PieceTokenizer(b)
        # No piece has a mark after another character, so none crosses a word.
        self.cuts = not any(" " in o.lstrip(b" ").decode("utf-8", "replace") for o in self.b.octets)
        self.sizes = [np.array([len(o) for o in t.octets], dtype=np.int64) for t in (self.a, self.b)]
        #: Text of a token: its id and what separates it from the next, by 2 * id + (it ends its side of a group); B's begin at ``middle``.
        self.middle = 2 * len(self.a.octets)
        self.written = [f"{i}{sep}" for end, n in (("|", len(self.a.octets)), (";", len(self.b.octets))) for i in range(n) for sep in (",", end)]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.texts: list[str] = []
        #: n_a, n_b, n_groups, n_links of each unit, whether its bytes come back, and where its links begin.
        self.numbers, self.starts, self.links = np.empty((0, 5), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def units(self, text: str) -> list[str]:
        """A text cut before spaces, which are left out; one unit where a cut would part a token."""
        if not text:
            return []
        return text.split(" ") if self.cuts and not self.UNCUT.search(" " + text) else [text]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of a space and each text, and whether the joined bytes of both sides are just that."""
        whole, sides = [(" " + t).encode() for t in texts], []
        fits = np.ones(len(texts), bool)
        for tokenizer, own in ((self.a, [" " + t for t in texts]), (self.b, texts)):
            ids = tokenizer.encode(own)
            fits &= [b"".join(map(tokenizer.octets.__getitem__, x)) == w for x, w in zip(ids, whole)]
            sides.append([np.array(x, dtype=np.int64) for x in ids])
        return *([x if ok else x[:0] for ok, x in zip(fits.tolist(), side)] for side in sides), fits

    def learn(self, fresh: list[str]) -> None:
        """Align units, laid end to end, and keep what comes of them."""
        *sides, fits = self.tokens(fresh)
        a, b = (np.concatenate(side) for side in sides)
        cuts_a, cuts_b = (np.concatenate(([0], np.cumsum([len(x) for x in side]))) for side in sides)
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b)))
        group_a, group_b, n = groups_of(ends_a, ends_b)
        written = list(map(self.written.__getitem__, _written(group_a, group_b, n, a, b, self.middle).tolist())) if n else []
        # Tokens that end together are in one component; ends are in order on either side.
        _, i, j = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        cuts_link, cuts_group = np.searchsorted(i, cuts_a), np.append(group_a, n)[cuts_a]
        both = (cuts_a + cuts_b).tolist()
        self.texts += ["".join(written[p:q]) for p, q in zip(both, both[1:])]
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.starts = np.concatenate((self.starts, len(self.links) + cuts_link[:-1]))
        self.links = np.concatenate((self.links, a[i] << 32 | b[j]))
        self.numbers = np.concatenate((self.numbers, np.stack([np.diff(cuts_a), np.diff(cuts_b), np.diff(cuts_group), np.diff(cuts_link), fits], axis=1)))

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, bytes]]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, links) of each text; links are its different id pairs with their numbers, packed."""
        split = [self.units(t) for t in texts]
        fresh = set().union(*split).difference(self.place)
        self.held += sum(map(len, fresh))
        if len(self.place) + len(fresh) > KEPT_UNITS or self.held > KEPT_CHARACTERS:
            self.forget()
            fresh = set().union(*split)
            self.held = sum(map(len, fresh))
        if fresh:
            self.learn(sorted(fresh))
        for own in split:
            at = list(map(self.place.__getitem__, own))
            units = np.array(at, dtype=np.int64)
            n_a, n_b, n_groups, n_links, fits = self.numbers[units].sum(axis=0).tolist()
            if not at or fits < len(at):
                yield 0, 0, 0, 0, "", b""
                continue
            text = "".join(map(self.texts.__getitem__, at))[:-1]
            each = self.numbers[units, 3]
            places = np.arange(n_links) + np.repeat(self.starts[units] - np.cumsum(each) + each, each)
            yield n_a, n_b, n_groups, n_links, hashlib.sha256(text.encode()).hexdigest(), packed(self.links[places])


@lru_cache(maxsize=2)
def _aligner(a: str, b: bytes) -> Aligner:
    return Aligner(a, b)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of tokens whose byte ranges overlap; both sides cover the same bytes without a gap.

    Of two that overlap, the one that begins later begins inside the other:
    every token of A meets the token of B in which it begins, and the other way round.
    """
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    of_a = np.searchsorted(ends_b, starts_a, side="right")
    of_b = np.searchsorted(ends_a, starts_b, side="right")
    later = starts_a[np.minimum(of_b, len(ends_a) - 1)] != starts_b  # those that begin together are there already
    i = np.concatenate((np.arange(len(ends_a)), of_b[later]))
    j = np.concatenate((of_a, np.flatnonzero(later)))
    return i, j


def united(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union-find over edges (i, j), all at once: the least member of each of ``size`` nodes' components."""
    root = np.arange(size)
    while len(i):
        high, low = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
        order = np.argsort(-low, kind="stable")
        root[high[order]] = low[order]  # where a root is hooked more than once, the least one holds
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B, numbered in their order, and how many there are."""
    if not len(ends_a):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    i, j = overlaps(ends_a, ends_b)
    root = united(len(ends_a) + len(ends_b), i, j + len(ends_a))
    # Every component holds a token of A; its least member is its first one, so roots are in order.
    first = root[: len(ends_a)]
    number = np.cumsum(first == np.arange(len(ends_a))) - 1
    return number[first], number[root[len(ends_a) :]], int(number[-1]) + 1


def _written(group_a: np.ndarray, group_b: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, middle: int) -> np.ndarray:
    """Codes of all tokens in the order in which they are written."""
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    codes = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    codes[np.arange(len(a)) + before_b[group_a]] = 2 * a + last_a
    codes[np.arange(len(b)) + (before_a + in_a)[group_b]] = middle + 2 * b + last_b
    return codes


def aligned_batch(aligner: Aligner, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes]]:
    """What ``Aligner.align`` gives for each text, some at once."""
    out: list[tuple[int, int, int, int, str, bytes]] = []
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        out += aligner.align(texts[at:to])
        at = to
    return out


def packed(pairs: np.ndarray) -> bytes:
    """Different pairs and how often each occurs, compressed."""
    key, times = np.unique(pairs, return_counts=True)
    return blobs.pack(key, times.astype(np.uint32)) if len(key) else b""


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    key, times = blobs.unpack(blob) if blob else (np.empty(0, np.int64), np.empty(0, np.uint32))
    return key, times.astype(np.int64)


def aligned(documents: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) for every row's whole text."""
    with open(a_path, encoding="utf-8") as f:
        a = f.read()
    with open(b_path, "rb") as f:
        b = f.read()
    bounded_batches(documents.sparkSession)
    files = documents.sparkSession.sparkContext.broadcast((a, b))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for batch in batches:
            rows = aligned_batch(aligner, [t or "" for t in batch.column(1).to_pylist()])
            columns = [*zip(*rows)] or [()] * 6
            made = [pa.array(c, k) for c, k in zip(columns, (*[pa.int64()] * 4, pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(each, f"doc_id bigint, {NUMBERS}, groups_sha256 string, links binary")


def counted(links: DataFrame) -> DataFrame:
    """(pair, n): in how many links of all texts (column links) each id pair stands; added up in each task before the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        key, n, size = np.empty(0, np.int64), np.empty(0, np.int64), 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, times = (np.concatenate(c) for c in zip((key, n), *gathered))
            found, at = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, at, times)
            return found, sums

        def sent() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["pair", "n"])

        for b in batches:
            for blob in b.column(0).to_pylist():
                gathered.append(unpacked(blob))
                size += len(gathered[-1][0])
                if size > GATHERED:
                    (key, n), gathered, size = added(), [], 0
                    if len(key) > HELD:
                        yield from sent()
                        key, n = key[:0], n[:0]
        key, n = added()
        yield from sent()

    return links.select("links").mapInArrow(each, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def best_marked(pairs: DataFrame) -> DataFrame:
    """``pairs`` with best: whether a pair's count is the highest of its B id. B ids are as many as the vocabulary has."""
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _floor(pairs: DataFrame, most: int) -> int:
    """The least count above which there are at most ``most`` pairs."""
    held = 0
    for power, n in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect():
        held += n
        if held > most:
            return 1 << (power + 1)
    return 1


def aligned_counts(documents: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, sent: int = SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row's whole text.

    A text that is null or empty, or whose bytes either tokenizer does not
    give back (one that holds U+2581, say), has no tokens: zeros and ''.
    Ties for the highest count of a B id are all best. Repeated rows count
    and report each by itself; other columns are left out, whatever their
    names; an empty table gives an empty result. doc_id must be a whole number or null.
    ``sent`` bounds what is sent to every task and changes no result.
    """
    scratch = Scratch(documents.sparkSession)
    own = scratch.put(aligned(documents, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    pairs = scratch.put(best_marked(scratch.put(counted(own))))
    floor = _floor(pairs, sent)
    common = pairs.where(F.col("n") >= floor).toArrow()
    order = np.argsort(common.column("pair").to_numpy())
    table_of = documents.sparkSession.sparkContext.broadcast(tuple(common.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    passed = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table_of.value
        for b in batches:
            rows = []
            for blob in b.column(len(passed)).to_pylist():
                pair, times = unpacked(blob)
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                at, of = at[known], times[known]
                rows.append((int(of[best[at]].sum()), int((of * counts[at]).sum()), pair[~known], times[~known]))
            n_best, count_sum, asked, times = zip(*rows) if rows else ((), (), (), ())
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in asked]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *x]))) for x in (asked, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(passed)], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), *lists], names=[*passed, "n_best", "count_sum", "asked", "times"])

    found = own.select(*passed, "links").mapInArrow(each, f"row bigint, doc_id bigint, {NUMBERS}, groups_sha256 string, n_best bigint, count_sum bigint, asked array<bigint>, times array<bigint>")
    if floor > 1:
        found = scratch.put(found)
        asked = found.select(F.col("row").alias("_row"), F.explode(F.arrays_zip("asked", "times")).alias("x")).select("_row", F.col("x.asked").alias("pair"), F.col("x.times").alias("times"))
        rest = asked.join(pairs.where(F.col("n") < floor), "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
        found = found.join(rest, F.col("row") == F.col("_row"), "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(table(spark, sf_dir, "documents"))
