"""SentencePiece encoding and decoding by one forward pass over a trie of the distinct words.

The distinct marked words of a batch are cut where no piece holds both
characters beside the cut ("word." before its full stop), and the parts that
are new are sorted, so that each shares its longest common prefix with the one
before: the sorted list is a depth-first walk of their trie. A stack holds the
forward state of every prefix on the path, and what a part shares with the
last one is not computed again.

For a unigram model the state of a prefix is its best score and last piece
(Viterbi). A BPE model's result is no best path over scores; there the state
is the last piece of the prefix's own encoding, which is the one suffix piece
that its merges leave beside the state before it, so that the result is the
library's for either kind. Whether merges leave two pieces beside each other
is told from the merges that make each of them, in the order of their scores.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: The default model; callers may name another.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words kept between batches in a worker; when so many are held, the store is emptied.
KEPT_WORDS = 800_000
#: Different parts of words kept likewise.
KEPT_PARTS = 400_000
#: Slots by hash of the pairs of characters that pieces hold; pairs that share a slot only lessen cuts.
SLOTS = 1 << 20
#: The candidates for a last piece are kept by so many last characters.
TAIL = 4
#: A longer word of a BPE model is merged by itself, without a state for each of its prefixes.
LONG_WORD = 512

UNIGRAM, BPE = 1, 2

#: A worker's encoders by the model's digest, so that what it has met serves its next task too.
_encoders: dict[bytes, Encoder] = {}


@dataclass
class Model:
    """Pieces with scores; ``ids`` holds those that text may become."""

    kind: int
    pieces: list[str]
    scores: list[float]
    ids: dict[str, int]
    unk: int
    byte_ids: dict[int, int]
    dummy_prefix: bool = True
    longest: int = 1

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids), default=1)

    def digest(self) -> bytes:
        return hashlib.sha256(repr((self.kind, self.pieces, self.scores, sorted(self.ids.items()), self.unk, self.byte_ids, self.dummy_prefix)).encode()).digest()


def load_model(path: str) -> Model:
    """The pieces of a model file, read on the driver; executors get them with the task."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    held = proto.ModelProto()
    with open(path, "rb") as f:
        held.ParseFromString(f.read())
    if held.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are known")
    if held.normalizer_spec.precompiled_charsmap or held.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with the identity normalizer are known")
    sp = SentencePieceProcessor(model_proto=held.SerializeToString())
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Model(
        held.trainer_spec.model_type, pieces, [sp.get_score(i) for i in range(n)], {pieces[i]: i for i in plain}, sp.unk_id(),
        {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}, held.normalizer_spec.add_dummy_prefix,
    )


class Encoder:
    """Encodes texts; equal words are encoded once, common prefixes of different ones too."""

    #: No piece has a mark after another character, so no piece crosses these words' bounds.
    WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, model: Model):
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in model.ids):
            raise ValueError("pieces cross words")
        self.m = model
        self.kept: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        #: For each piece, what is known of the pieces that it stands beside, and how much that is in all.
        self.fits: dict[str, dict[str, bool]] = {p: {} for p in model.ids}
        self.known = 0
        self.made: dict[str, list[tuple[float, str, str]] | None] = {}
        held = {i: b for b, i in model.byte_ids.items()}
        octets = [bytes([held[i]]) if i in held else p.replace(MARK, " ").encode() for i, p in enumerate(model.pieces)]
        #: The bytes of all pieces end to end, where each begins and how many it has.
        self.octets = np.frombuffer(b"".join(octets), np.uint8)
        self.sizes = np.array([len(o) for o in octets], dtype=np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        #: Lengths of the pieces longer than a tail, by the tail that they end with, and of all pieces that may end with a tail.
        self.longer: dict[str, tuple[int, ...]] = {}
        for p in model.ids:
            if len(p) > TAIL and len(p) not in self.longer.get(p[-TAIL:], ()):
                self.longer[p[-TAIL:]] = (*self.longer.get(p[-TAIL:], ()), len(p))
        self.tails: dict[str, tuple[int, ...]] = {}
        # Unknown characters side by side have one id between them if there are no bytes for them: then nothing is cut.
        self.joined = np.full(SLOTS, not model.byte_ids)
        pairs = {p[k : k + 2] for p in model.ids for k in range(len(p) - 1)}
        codes = _codes("".join(pairs)).reshape(-1, 2)
        self.joined[_slots(codes[:, 0], codes[:, 1])] = True
        self.packed = {p: i.to_bytes(4, "little") for p, i in model.ids.items()}

    def words(self, text: str) -> list[str]:
        return self.WORD.findall((MARK if self.m.dummy_prefix else "") + text.replace(" ", MARK))

    def _keys(self, text: str) -> list[str]:
        """The words, without their mark where each has just one and the text has none of its own; then no other key is without it."""
        if MARK in text or "  " in text or text[-1] == " " or text[0] == " " or not self.m.dummy_prefix:
            return self.words(text)
        return text.split(" ")

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit little-endian integers."""
        split = [self._keys(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.kept)
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept = {}
            fresh = set().union(*split)
        if fresh:
            self._learn(list(fresh))
        get = self.kept.__getitem__
        return [b"".join(map(get, own)) for own in split]

    def _learn(self, keys: list[str]) -> None:
        """Keep the ids of new words, which are those of their parts one after another."""
        words = [k if k[0] == MARK else MARK + k for k in keys] if self.m.dummy_prefix else keys
        text = "".join(words)
        codes = _codes(text)
        first = np.ones(len(codes) + 1, bool)
        first[1:-1] = ~self.joined[_slots(codes[:-1], codes[1:])]
        bounds = np.cumsum([0, *map(len, words)])
        first[bounds] = True
        starts = np.flatnonzero(first)
        parts = [text[a:b] for a, b in pairwise(starts.tolist())]
        fresh = set(parts).difference(self.parts)
        if len(self.parts) + len(fresh) > KEPT_PARTS:
            self.parts = {}
            fresh = set(parts)
        (self._walk_bpe if self.m.kind == BPE else self._walk_unigram)(sorted(fresh))
        packed = list(map(self.parts.__getitem__, parts))
        places = np.searchsorted(starts, bounds).tolist()
        self.kept.update(zip(keys, [packed[a] if b - a == 1 else b"".join(packed[a:b]) for a, b in pairwise(places)]))

    def _walk_bpe(self, words: list[str]) -> None:
        """Depth-first over the trie of sorted words; pieces[k] is the last piece of the first k characters, states[k] their ids.

        Of the suffix pieces of a prefix, that is the one which its merges
        leave beside the last piece before it; if no longer one is, it is the last character.
        """
        fits, tails, packed = self.fits, self.tails, self.packed
        pieces, states, last = [""], [b""], ""
        for word in words:
            n = len(word)
            if n > LONG_WORD:
                self.parts[word] = self._bytes(_merge(word, self.m))
                continue
            k = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                k += 1
            del pieces[k + 1 :], states[k + 1 :]
            for end in range(k + 1, n + 1):
                tail = word[end - TAIL : end] if end > TAIL else word[:end]
                sizes = tails.get(tail)
                if sizes is None:
                    sizes = self._sizes(tail)
                for size in sizes:
                    start = end - size
                    if start < 0 or (known := fits.get(piece := word[start:end])) is None:
                        continue
                    ok = known.get(before := pieces[start])
                    if ok is None:
                        ok = self._keep(before, piece)
                    if ok:
                        break
                else:
                    start, piece = end - 1, word[end - 1]
                pieces.append(piece)
                states.append(states[start] + packed[piece] if piece in packed else self._unknown(states[start], piece))
            last = word
            self.parts[word] = states[n]

    def _keep(self, before: str, piece: str) -> bool:
        if self.known > KEPT_WORDS:
            self.known = 0
            for own in self.fits.values():
                own.clear()
        self.known += 1
        ok = self.fits[piece][before] = self._beside(before, piece)
        return ok

    def _unknown(self, state: bytes, piece: str) -> bytes:
        """Ids with those of an unknown character after them: its bytes, else one id for all that stand side by side."""
        if self.m.byte_ids or state[-4:] != self.m.unk.to_bytes(4, "little"):
            return state + self._bytes([piece])
        return state

    def _sizes(self, tail: str) -> tuple[int, ...]:
        """Lengths of the pieces of two characters or more that a string with this tail may end with."""
        if len(self.tails) > KEPT_WORDS:
            self.tails.clear()
        own = [k for k in range(2, len(tail) + 1) if tail[-k:] in self.m.ids]
        found = self.tails[tail] = (*own, *self.longer.get(tail, ()))
        return found

    def _beside(self, a: str, b: str) -> bool:
        """Whether the merges of a + b leave just these two pieces, or b alone where a is empty.

        As long as none crosses the bound, either side's merges are its own,
        taken by their scores, the left side's first. One that crosses must
        never be the next: it comes after better ones and equal ones to its left.
        """
        left, right = self._merges(a), self._merges(b)
        if left is None or right is None:
            return False
        if not a:
            return True
        ids, scores = self.m.ids, self.m.scores
        i = j = 0
        end, start = a[-1], b[0]
        worst = float("-inf")
        across = ids.get(end + start)
        while True:
            next_a = left[i][0] if i < len(left) else worst
            next_b = right[j][0] if j < len(right) else worst
            if across is not None and (s := scores[across]) >= next_b and s > next_a:
                return False
            if i < len(left) and (next_a >= next_b or j == len(right)):
                own, i = left[i][2], i + 1
                if own != end:
                    end, across = own, ids.get(own + start)
            elif j < len(right):
                own, j = right[j][1], j + 1
                if own != start:
                    start, across = own, ids.get(end + own)
            else:
                return True

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters: score, and the first and last part after each; None if they don't make it."""
        if len(piece) < 2:
            return []
        if piece not in self.made:
            steps: list[tuple[float, str, str]] = []
            self.made[piece] = steps if len(_merge(piece, self.m, steps)) < 2 else None
        return self.made[piece]

    def _walk_unigram(self, words: list[str]) -> None:
        """Depth-first over the trie of sorted words; states[k] is the best score, start and last piece of the first k characters."""
        states: list[tuple] = [(0.0, 0, "")]
        last = ""
        for word in words:
            k = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                k += 1
            del states[k + 1 :]
            for end in range(k + 1, len(word) + 1):
                states.append(self._viterbi_step(word, end, states))
            last = word
            self.parts[word] = self._bytes(_backtrack(word, states))

    def _viterbi_step(self, word: str, end: int, states: list[tuple]) -> tuple:
        """Best score over all last pieces; an unknown character costs ten more than the worst piece."""
        best = None
        for start in range(max(0, end - self.m.longest), end):
            piece = word[start:end]
            i = self.m.ids.get(piece)
            if i is None and end - start > 1:
                continue
            score = states[start][0] + (self.m.scores[i] if i is not None else min(self.m.scores) - 10)
            if best is None or score > best[0]:
                best = (score, start, piece)
        return best

    def _bytes(self, pieces: list[str]) -> bytes:
        packed = self.packed
        try:
            return b"".join([packed[p] for p in pieces])
        except KeyError:
            out: list[int] = []
            for p in pieces:
                if p in self.m.ids:
                    out.append(self.m.ids[p])
                elif self.m.byte_ids:
                    out += [self.m.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
                elif not out or out[-1] != self.m.unk:
                    out.append(self.m.unk)
            return np.array(out, dtype="<i4").tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text again: the pieces' bytes joined, marks as spaces, without the first one if the model adds it."""
        ids = np.asarray(ids, dtype=np.int32)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        places = np.repeat(self.starts[ids] - ends + sizes, sizes)
        places += np.arange(len(places), dtype=np.int32)
        text = self.octets[places].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.m.dummy_prefix and text[:1] == " " else text


def _backtrack(word: str, states: list[tuple]) -> list[str]:
    out, end = [], len(word)
    while end:
        _, start, piece = states[end]
        out.append(piece)
        end = start
    return out[::-1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b) & np.uint32(SLOTS - 1)


def _merge(word: str, m: Model, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
    """BPE by its rule: merge the adjacent pair whose piece scores best, leftmost first, until none is a piece.

    ``steps``, if given, gets each merge's score and the first and last part after it.
    """
    import heapq

    parts: list[str] = list(word)
    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (i := m.ids.get(parts[a] + parts[b])) is not None:
            heapq.heappush(heap, (-m.scores[i], a, parts[a] + parts[b]))

    for k in range(n - 1):
        offer(k, k + 1)
    end = n - 1
    while heap:
        score, a, made = heapq.heappop(heap)
        b = right[a]
        if not parts[a] or b < 0 or parts[a] + parts[b] != made:
            continue
        parts[a], parts[b] = made, ""
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        if b == end:
            end = a
        if steps is not None:
            steps.append((-score, parts[0], parts[end]))
        offer(left[a], a)
        offer(a, right[a])
    return [p for p in parts if p]


def encoded(documents: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip) for every row's whole text.

    A null or empty text has no ids. round_trip tells whether the ids decode
    to the text; it is false only for a text that holds the mark U+2581
    itself, which the model cannot tell from a space. Rows are independent,
    so repeated ones repeat; other columns are left out.
    """
    bounded_batches(documents.sparkSession)
    model = load_model(model_path)
    digest = model.digest()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(digest) or _encoders.setdefault(digest, Encoder(model))
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [np.frombuffer(x, dtype="<i4") for x in encoder.encode_batch(texts)]
            again = [encoder.decode(x) for x in ids]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, "<i4"), *ids]))),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in again]),
                    pa.array([t == (x or "") for t, x in zip(again, texts)]),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(each, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
