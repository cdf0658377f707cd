"""Vectorised text primitives: code points, words, polynomial range hashes, winnowing.

Everything works on a chunk of texts at once with numpy, so that no Python code runs per character or word.
A range hash is a polynomial over code points modulo 2^64 with an odd base, taken from prefix sums:
``(S[end] - S[start]) * base^-start``; equal texts have equal hashes wherever they stand.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Code points handled at a time; a longer text forms a chunk of its own.
CHUNK = 1 << 20

_tables: dict[str, np.ndarray] = {}


def word_table() -> np.ndarray:
    """For each code point whether it is a letter or a digit."""
    if "word" not in _tables:
        _tables["word"] = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, CHUNK + 1)
        for name, b in (("pow", _BASE), ("inv", _INV)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["pow"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a line feed between them; start and end of each text."""
    a = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + 1) - 1
    return a, ends - lens, ends


class RangeHash:
    """Hashes of any ranges of one code array."""

    def __init__(self, codes: np.ndarray):
        p, self._inv = _powers(len(codes) + 1)
        self._s = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], out=self._s[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._s[end] - self._s[start]) * self._inv[start] + (end - start).astype(np.uint64))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of letters and digits, lower case) and the number of words before each text, closed by their total."""
    codes, _, ends = codes_of([t.lower() for t in texts])
    is_word = np.zeros(len(codes) + 2, bool)
    is_word[1:-1] = word_table()[codes]
    at = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = at[::2], at[1::2]
    return RangeHash(codes)(start, end), np.concatenate(([0], np.searchsorted(start, ends)))


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words that lies in one text, and the offsets of each text's first."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    first = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        h = mix(h + words[first + k])
    return h, out


def chunks(columns: list[list], text_at: int, size: int = CHUNK) -> Iterator[list[list]]:
    """Rows in chunks whose texts hold about size characters."""
    begin = held = 0
    for i, t in enumerate(columns[text_at]):
        if held and held + len(t) > size:
            yield [c[begin:i] for c in columns]
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(columns[0]):
        yield [c[begin:] for c in columns]


def sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over a[i : i + w], for each i with a full window."""
    have, out = 1, a
    while have * 2 <= w:
        out, have = op(out[:-have], out[have:]), have * 2
    return op(out[: len(a) - w + 1], out[w - have : len(a) - have + 1]) if w > have else out


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Mask of the hashes that are the least of any w consecutive ones."""
    chosen = np.zeros(len(h), bool)
    if len(h) < w:
        return chosen
    least = sliding(h, w, np.minimum)
    padded = np.concatenate((np.zeros(w - 1, h.dtype), least, np.zeros(w - 1, h.dtype)))
    return sliding(padded, w, np.maximum) == h
