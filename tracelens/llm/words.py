"""Vectorised word, shingle and n-gram hashing over batches of text.

Texts are laid end to end as one byte array; words, their 64-bit hashes and windows over words come
from prefix sums, so there is no Python loop over words.  Every function takes whole texts.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD_BYTE[_c] = True

#: Characters of the texts that are worked on at once (or one longer text), and powers that a process keeps of a base.
SLICE, POWERS = 500_000, 1 << 21

_powers: dict[int, np.ndarray] = {}


def _raised(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    np.multiply.accumulate(out, out=out)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; the first POWERS of them are kept, more are made anew."""
    if n > POWERS:
        return _raised(base, n)
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = _raised(base, min(POWERS, max(1 << 16, 2 * n)))
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on a copy."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[starts:ends] for each span that depends on nothing outside it."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    term = values.astype(np.uint64)
    term += np.uint64(1)
    term *= powers(BASE, n)
    np.cumsum(term, out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def lay_out(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """Lower-cased texts end to end in UTF-8 with a line feed after each, and where each begins (one more: the end)."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return b"\n".join(parts) + b"\n" if parts else b"", bounds


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in a byte array that doesn't end within a word."""
    inside = WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text (one more: the end) the index of its first word."""
    raw, bounds = lay_out(texts)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data)
    return span_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of `width` successive words of each text, end to end, and their bounds.

    A text of fewer words has one shingle, of all its words; one without words has none.
    """
    hashes, bounds = words(texts)
    counts = np.diff(bounds)
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), each)
    first = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=first[1:])
    start = bounds[:-1][doc] + np.arange(len(doc)) - first[doc]
    value = span_hashes(hashes, start, start + np.minimum(width, counts)[doc])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))


def slices(texts: list[str | None], most: int = SLICE):
    """Ranges of rows whose texts have `most` characters together at most, or are one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
