"""Words, lines and character classes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Its identity is a 64-bit hash: the sum, over its bytes, of a
pseudo-random number for the byte and its place in the word, finished by a mixer together with the length.  Places have
numbers of their own, so no pattern of bytes makes unlike words equal, as it does with powers of a base modulo 2^64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Places whose numbers are held in a table; those of later ones are computed.
PLACES = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _numbers(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((byte.astype(U) + (place.astype(U) << U(8)) + U(1)) * U(0xD6E8FEB86659FD93))


_TABLE = _numbers(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256))
_SAME = np.arange(256, dtype=np.uint8)
_FOLDED = _SAME.copy()
_FOLDED[65:91] = _SAME[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, folded: bool = False) -> np.ndarray:
    """The hash of the bytes of each [start, end); spans are in order and don't overlap."""
    if not len(start):
        return np.empty(0, U)
    first = np.zeros(len(data), np.int64)
    first[start[end > start]] = start[end > start]
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    byte = _FOLDED[data] if folded else data
    far = np.flatnonzero(place >= PLACES)
    numbers = _TABLE[(np.minimum(place, PLACES - 1) << 8) + byte]
    numbers[far] = _numbers(byte[far], place[far])
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(numbers, out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(U))


@dataclass
class Words:
    hash: np.ndarray  # of each word
    start: np.ndarray  # its first byte
    end: np.ndarray
    first: np.ndarray  # the index of each document's first word, and the number of all words

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and whether each byte is white space; no word reaches over a document's end."""
    space = SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    full = at[1:] > at[:-1]
    before[at[:-1][full]] = True
    after[at[1:][full] - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1, space


def words(data: np.ndarray, at: np.ndarray, folded: bool) -> Words:
    start, end, _ = edges(data, at)
    return Words(spans_hash(data, start, end, folded), start, end, np.searchsorted(start, at, "left"))


def totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the values of each document's range."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of `size` words of one document."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    h = np.zeros(n, U)
    for k in range(size):
        h = h * U(0xC2B2AE3D27D4EB4F) + w.hash[k : n + k]
    counts = np.diff(w.first)
    whole = np.arange(n) + size <= np.repeat(w.first[1:], counts)[:n]
    index = np.flatnonzero(whole)
    return index, mix(h[index])
