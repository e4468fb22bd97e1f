"""Polynomial prefix hashes over the words of whole batches of texts: every window's hash is one subtraction.

A word's hash is a sum of random numbers of its bytes times powers of an odd number, all modulo 2^64; a text's prefix hashes
are running sums of its words' hashes times powers of another one, so the words from i to i + k hash to
(P[i + k] - P[i]) times the inverse power of i, wherever they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd multipliers of bytes within a word and of words within a window; what each byte value stands for is drawn once.
BYTE, WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: White space as the collapsed form of a text knows it.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of words that are hashed at once.
BLOCK = 1 << 20


@lru_cache(8)
def _powers(base: int, bits: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, 2^bits of them."""
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(10, int(n - 1).bit_length()))[:n] if n else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a space after each, and the n + 1 offsets; null counts as empty."""
    texts = [(x or "").encode() for x in column.to_pylist()]
    offs = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), offs


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words before each text and of all."""
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    lo, total = 0, np.concatenate([[0], np.cumsum(ends - starts)])
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK, "right")) - 1)
        size = ends[lo:hi] - starts[lo:hi]
        first = total[lo:hi] - total[lo]
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            parts = _VALUES[data[np.repeat(starts[lo:hi], size) + place]] * powers(BYTE, int(size.max()))[place]
            out[lo:hi] = mixed(np.add.reduceat(parts, first) + size.astype(np.uint64))
        lo = hi
    return out


def prefixes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of hashes times powers, from 0."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(WORD, len(hashes)), dtype=np.uint64)])


def windows(prefix: np.ndarray, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Hashes of the k words from each place ``at``."""
    with np.errstate(over="ignore"):
        inverse = powers(pow(WORD, -1, 1 << 64), int(at.max()) + 1 if len(at) else 0)
        return mixed((prefix[at + k] - prefix[at]) * inverse[at] + np.asarray(k).astype(np.uint64))
