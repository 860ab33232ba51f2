"""Hashed words and n-grams of whole batches of texts, as array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that are hashed together: the arrays of a slice take about 60 bytes for each.
SPAN = 1 << 17

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts of the texts in them) of about SPAN bytes each."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SPAN)))
        last = min(last, len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word (a run without white space)."""
    n = len(data)
    inside = ~_IS_SPACE[data]
    border = np.zeros(n + 1, bool)
    border[starts] = True  # no word crosses two texts
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | border[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[begin]) * _powers(_BACK, n + 1)[begin]), np.searchsorted(starts, begin, side="right") - 1


def ngram_hashes(words: np.ndarray, text: np.ndarray, n: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of n words; with ``whole_if_short`` a
    text of fewer words has one n-gram of all its words."""
    m = max(0, len(words) - n + 1)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc += words[k : k + m] * _MIX[k]
    same = text[:m] == text[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
    grams, of = mix(acc[same]), text[:m][same]
    if whole_if_short and len(words):
        ids, first, size = np.unique(text, return_index=True, return_counts=True)
        short = size < n
        if short.any():
            extra = np.zeros(int(short.sum()), np.uint64)
            f, s = first[short], size[short]
            for k in range(n - 1):
                own = s > k
                extra[own] += words[f[own] + k] * _MIX[k]
            grams, of = np.concatenate([grams, mix(extra + s.astype(np.uint64))]), np.concatenate([of, ids[short]])
            order = np.argsort(of, kind="stable")
            grams, of = grams[order], of[order]
    return grams, of
