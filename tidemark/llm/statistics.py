"""Statistics of whole documents, computed from byte arrays for many documents at once."""

from __future__ import annotations

import numpy as np

from tidemark.llm._words import SPACE, U, Words, mix, spans_hash, totals, windows, words

_bytes = np.arange(256)
UPPER = (_bytes >= 65) & (_bytes <= 90)
DIGIT = (_bytes >= 48) & (_bytes <= 57)
LETTER = UPPER | (_bytes >= 97) & (_bytes <= 122) | (_bytes >= 128)
SYMBOL = np.isin(_bytes, list(b"#*$%&|<>"))
STOP = np.isin(_bytes, list(b".,;:?"))
SHOUT = _bytes == ord("!")
MARK = (_bytes > 32) & (_bytes < 127) & ~LETTER & ~DIGIT
FIRST = (_bytes & 0xC0) != 0x80  # a code point's first byte

#: Names of the columns of `profile`.
PROFILE = ["log_words", "word_length", "word_spread", "upper", "digit", "symbol", "stop", "shout", "mark", "wide", "lines", "distinct_words", "repeated_lines", "repeated_words", "bare_words"]


def repeats(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each item of a document is equal to an earlier one of it."""
    key = hashes ^ mix(owner.astype(U) + U(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def repeated_words(w: Words, size: int = 5) -> np.ndarray:
    """Of each document: the words in windows of `size` words that it has twice or more, the first one included."""
    index, hashes = windows(w, size)
    doc = w.doc
    key = hashes ^ mix(doc[index].astype(U) + U(1))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = index[order[twice]]
    change = np.zeros(len(doc) + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + size, -1)
    return totals(np.cumsum(change[:-1]) > 0, w.first)


def lines(data: np.ndarray, at: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(owner, whether it is equal to an earlier one of the document) of each line, cut at line feeds, that has a word.

    Hashes find the lines that may be equal; their bytes decide.
    """
    cut = np.flatnonzero(data == 10)
    start = np.union1d(at[:-1], cut + 1)
    start = start[start < len(data)]
    owner = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.r_[cut, len(data)][np.searchsorted(cut, start)], at[owner + 1])
    has = np.searchsorted(w.start, end, "left") > np.searchsorted(w.start, start, "left")
    hashes, owner, start, end = spans_hash(data, start, end)[has], owner[has], start[has], end[has]
    again = repeats(owner, hashes)
    seen = set()
    for k in np.flatnonzero(np.isin(hashes, hashes[again])).tolist():
        line = (int(owner[k]), data[start[k] : end[k]].tobytes())
        again[k] = line in seen
        seen.add(line)
    return owner, again


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document; case counts."""
    w = words(data, at, False)
    owner, again = lines(data, at, w)
    return {
        "n_words": np.diff(w.first),
        "word_chars": totals(FIRST[data] & ~SPACE[data], at),
        "n_symbols": totals(SYMBOL[data], at),
        "n_dup_lines": np.bincount(owner[again], minlength=len(at) - 1),
        "n_repeat_words": repeated_words(w),
    }


def profile(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of the numbers in PROFILE for each document; an empty one has zeros."""
    w = words(data, at, False)
    owner, again = lines(data, at, w)
    n = np.diff(w.first).astype(float)
    some, length = np.maximum(n, 1), np.maximum(totals(~SPACE[data], at), 1).astype(float)
    share = lambda table: np.sqrt(totals(table[data], at) / length)
    sizes = (w.end - w.start).astype(np.int64)
    mean = totals(sizes, w.first) / some
    spread = np.sqrt(np.maximum(totals(sizes * sizes, w.first) / some - mean**2, 0))
    n_lines = np.bincount(owner, minlength=len(at) - 1)
    # words without any letter, and words that end in a mark other than a stop
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(LETTER[data], out=letters[1:])
    tail = MARK[data[w.end - 1]] & ~STOP[data[w.end - 1]] if len(sizes) else np.empty(0, bool)
    bare = totals((letters[w.end] == letters[w.start]) | tail, w.first)
    return np.column_stack([
        np.log1p(n), mean, np.log1p(spread), share(UPPER), share(DIGIT), share(SYMBOL), share(STOP), share(SHOUT), share(MARK), share(_bytes >= 128),
        np.log1p(n / np.maximum(n_lines, 1)), 1 - totals(repeats(w.doc, w.hash), w.first) / some,
        np.bincount(owner[again], minlength=len(at) - 1) / np.maximum(n_lines, 1), repeated_words(w) / some, bare / some,
    ])
