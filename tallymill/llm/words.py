"""Hashes of the words of whole batches of texts, in numpy.

Words are runs of other bytes than space and 9 to 13, with A-Z lowered.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of a word beyond which it is hashed by itself.
LONG = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, and how many words each text has.

    A word is hashed in steps of eight bytes, so the work is a few operations a word.
    """
    n, total = len(offs) - 1, len(data)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    for flags, edges in ((first, offs[:-1][full]), (last, offs[1:][full] - 1)):
        flags[edges] = inside[edges]
    starts = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - starts
    counts = np.diff(np.searchsorted(starts, offs))
    low = np.zeros(total + 8, np.uint8)
    np.take(_LOWER, data, out=low[:total])
    return _hashes(low, starts, size)[0], counts


def names(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the bytes of each span, as two numbers."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return _hashes(padded, starts, size, True)


def _hashes(padded: np.ndarray, starts: np.ndarray, size: np.ndarray, two: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of spans of bytes (eight zeros follow the last), in steps of eight; the second one only if ``two``."""
    eight = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = h + np.uint64(0x6A09E667F3BCC909)
    which, at, left = slice(None), starts, np.where(size > LONG, 0, size)
    with np.errstate(over="ignore"):
        while len(at):
            part = eight[at] & _MASK[np.minimum(left, 8)]
            h[which] = mix(h[which] ^ part)
            if two:
                more = (g[which] ^ part) * np.uint64(0xD6E8FEB86659FD93)
                g[which] = more ^ (more >> np.uint64(32))
            more = np.flatnonzero(left > 8)
            which = more if isinstance(which, slice) else which[more]
            at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(padded[starts[k] : starts[k] + size[k]], digest_size=16).digest()
        h[k], g[k] = np.frombuffer(digest, "<u8")
    return h, g
