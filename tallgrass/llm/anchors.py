"""Anchors of byte strings: positions that equal long strings have in common.

For strings of LENGTH bytes, the GRAM-byte substring with the smallest hash of each
such string is an anchor (all of them on a tie).  Two equal strings have the same
anchors at the same places, so equal strings meet under the hash of an anchor,
while only about two of every LENGTH - GRAM + 2 positions are anchors.

Grams of a period of PERIOD bytes or less come after all others.  So strings that
reach out of a periodic run are anchored at its border or outside, and a string that
lies in a run is anchored at the first place of the smallest gram in it.  For these
anchors, windows are trimmed to the run and to one period: all inside one run are
equal, however long it is.
"""

from __future__ import annotations

import numpy as np

from .ngrams import _BACK, _BASE, _BYTE, _powers, mix

LENGTH, GRAM, PERIOD = 400, 128, 64
_LATE = np.uint64(1 << 63)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each run of ``width`` values."""
    n = len(values)
    pad = -n % width
    fill = values.dtype.type(np.iinfo(values.dtype).max if best is np.minimum else 0)
    blocks = np.concatenate([values, np.full(pad, fill)]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


class _Hashes:
    """Hashes of the substrings of one text."""

    def __init__(self, data: np.ndarray, gram: int):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=self.total[1:])
        self.back, self.gram, self.half = _powers(_BACK, n + 1), gram, gram - PERIOD
        self.halves = (self.total[self.half :] - self.total[: -self.half]) * self.back[: n - self.half + 1]

    def of(self, first: np.ndarray, size) -> np.ndarray:
        return (self.total[first + size] - self.total[first]) * self.back[first]

    def periods(self, at: np.ndarray) -> np.ndarray:
        """The smallest period of each gram, 0 if beyond PERIOD."""
        out = np.zeros(len(at), np.int64)
        shift = np.arange(1, PERIOD + 1)
        for k in range(0, len(at), 2048):
            own = at[k : k + 2048]
            row, q = np.nonzero(self.halves[own[:, None] + shift] == self.halves[own][:, None])
            q += 1
            true = self.of(own[row], self.gram - q) == self.of(own[row] + q, self.gram - q)
            row, where = np.unique(row[true], return_index=True)  # the first is the smallest
            out[k + row] = q[true][where]
        return out


def _selected(value: np.ndarray, width: int) -> np.ndarray:
    least = sliding(value, width, np.minimum)
    # the largest of the minima of all windows around a position is its own value if it is one of them
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == value)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, hash of the window, and first and last byte of the window.

    The windows of an anchor's places hold every string that it anchors.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    hashes = _Hashes(data, gram)
    value = mix((hashes.total[gram:] - hashes.total[:-gram]) * hashes.back[: n - gram + 1]) & ~_LATE
    width = length - gram + 1
    known = np.zeros(0, np.int64)
    while True:
        at = _selected(value, width)
        fresh = at[value[at] < _LATE]
        fresh = fresh[~np.isin(fresh, known, assume_unique=True)]
        own = hashes.periods(fresh)
        known = np.append(known, fresh)
        late = fresh[own > 0]
        if not len(late):
            break
        # all places of these grams, as far as they are in this text
        value[np.isin(value, value[late])] |= _LATE
    first, last = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
    late = np.flatnonzero(value[at] >= _LATE)
    if len(late):
        q = hashes.periods(at[late])
        for k, i, p in zip(late.tolist(), at[late].tolist(), q.tolist(), strict=True):
            same = data[max(first[k], p) : last[k]] == data[max(first[k], p) - p : last[k] - p]
            begin = max(first[k], p)
            before = np.flatnonzero(~same[: i - begin]) if i > begin else np.zeros(0, np.int64)
            run = begin + int(before[-1]) + 1 - p if len(before) else (begin - p if begin == p else first[k])
            after = np.flatnonzero(~same[max(0, i + gram - begin) :])
            stop = i + gram + int(after[0]) if len(after) else last[k]
            first[k], last[k] = max(first[k], run, i - p + 1), min(last[k], stop)
        good = np.ones(len(at), bool)
        good[late] = last[late] - first[late] >= length
        at, first, last = at[good], first[good], last[good]
    window = mix(mix(hashes.of(first, last - first) + (at - first).astype(np.uint64)) + (last - first).astype(np.uint64))
    return at, value[at].view(np.int64), window.view(np.int64), first, last
