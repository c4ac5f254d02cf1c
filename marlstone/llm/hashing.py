"""Hashed words of whole texts, for the operators that count and score them in Python.

A word's hash is a polynomial over its bytes, A-Z lower-cased, with a random
64-bit value for each byte, taken from running sums of a whole batch; words
of more than LONG bytes get XXH64 in its place, as long ones can be made to collide. Equal words get equal hashes in
every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Longer words, in bytes, are hashed by themselves. Modulo 2**64 a polynomial gives the two Thue-Morse words of 1,024 bytes one hash; of those
#: of 64 bytes, whose difference has 27 factors of two at least, it keeps 37 bits apart.
LONG = 64
#: Bytes of a batch whose words are summed together.
BLOCK = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    grown = np.full(BLOCK + LONG + 1, base, dtype=np.uint64)
    grown[0] = 1
    return np.cumprod(grown, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def texts_of_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, one after another, and where each begins; a null text is empty."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    own = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return own, offsets - offsets[0]


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a batch of texts, in order, and how many words each text has."""
    if not len(column):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data, offsets = texts_of_batch(column)
    word = ~_SPACE[data]
    apart = np.ones(len(data) + 1, bool)
    apart[1:-1] = ~word[:-1]
    apart[offsets] = True
    starts = np.flatnonzero(word & apart[:-1])
    apart[:-1] = ~word
    apart[-1] = True
    apart[offsets] = True
    ends = np.flatnonzero(word & apart[1:]) + 1
    out = np.empty(len(starts), np.uint64)
    blocks = [*np.searchsorted(starts, np.arange(0, max(len(data), 1), BLOCK)).tolist(), len(starts)]
    for a, b in zip(blocks, blocks[1:]):
        if a == b:
            continue
        first = int(starts[a])
        piece = data[first : min(int(ends[b - 1]), first + BLOCK + LONG)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUES[piece] * _UP[: len(piece)], dtype=np.uint64, out=sums[1:])
        s, e = starts[a:b] - first, np.minimum(ends[a:b] - first, len(piece))
        out[a:b] = mixed((sums[e] - sums[s]) * _DOWN[s])
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return out, np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(column))


def word_hashes(text: bytes | None) -> np.ndarray:
    """The hashes of one text's words."""
    return batch_words(pa.array([text], pa.binary()))[0]


def joined_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each two in order."""
    both = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (b >> np.uint64(29)))
    return (both ^ (both >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours."""
    return joined_hashes(h[:-1], h[1:])
