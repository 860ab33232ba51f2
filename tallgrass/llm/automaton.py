"""Lazily determinised merge transducers, run over many chunks at once.

A byte-pair tokenizer is compiled into a weighted finite-state transducer over
bytes.  Its arcs are the pieces of the vocabulary; in the tropical semiring an arc
weighs 0 after a piece when the merge procedure, applied to both together, gives back
exactly these two pieces, and infinity otherwise.  Merges never cross a boundary that
is stable for the two pieces beside it, so the tokenizer's own segmentation is the
one path of weight 0.  With ``by_char``, the bytes of a character are arcs as well,
of weight FALLBACK each: the shortest path takes them where no piece has the character.

Determinisation is lazy: a state holds, for every start position from which a
piece can still end later, the trie node reached, the piece before it, the number of
pieces up to it relative to the newest position, and the weight of the shortest path to
it less the least of these (the residual).  At each position the shortest of the paths
that end there goes on.  Each transition carries the change of the piece count, so the
sum of what is emitted along a text is its number of tokens.  States and transitions
are made when first met; ``max_states`` bounds them (the table is dropped and built
anew beyond it).  A transition is one number, its state and the change of the count;
rows of states that are not made yet take no memory.

``run`` splits the input into chunks of equal length.  Each chunk gets its state map,
(entry state) -> (exit state, number of tokens), on the states that it can be entered
in: the start state first, then what the maps of the chunk before it lead to, until
nothing new comes up.  All chunks are run in step.  The maps are composed by a parallel
prefix scan, in rounds of doubled reach, which gives every chunk's entry state and the
number of tokens before it.  Should the maps not close in ROUNDS rounds (one word
over many chunks), the chunks concerned are run from their true entries in order.
"""

from __future__ import annotations

import ctypes
import gc
import weakref
from array import array

import numpy as np
import pyarrow as pa

RESET = 0xFF
BOS, UNKNOWN = -1, -2
FALLBACK = 1
ROUNDS = 6
_tables: weakref.WeakSet = weakref.WeakSet()


def release() -> None:
    """Drops the tables of this process, where other work goes on in a reused worker,
    and gives the system back what they and earlier batches took."""
    some = False
    for automaton in _tables:
        some |= len(automaton._keys) > 1
        automaton._clear()
        automaton._memo.clear()
    if some:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not the GNU library
            pass


def _rows(old: np.ndarray, rows: int, width: int, used: int, dtype=None) -> np.ndarray:
    """A larger table with the first ``used`` rows of ``old``; the others are not touched."""
    out = np.empty((rows, width), dtype or old.dtype)
    out[:used, : old.shape[1]] = old[:used]
    out[:used, old.shape[1] :] = -1
    return out


class MergeAutomaton:
    """Transducer of one vocabulary.

    ``pieces``: (id, bytes, closes) for each mergeable piece; a closing piece
    can only be the last one before RESET.  ``stable(left, right)`` says whether
    two pieces (left may be BOS) stay as they are next to each other.
    ``by_char``: pieces end at whole UTF-8 characters only, and a character that
    is no piece counts one token for each byte.  ``closing``: every run ends
    with a closing piece (word-end vocabularies).  ``special``: (id, bytes) of
    strings that are always one closing token.
    """

    def __init__(self, pieces, stable, *, by_char=False, closing=False, special=(), max_states=260_000):
        self._stable, self.by_char, self.closing, self.max_states = stable, by_char, closing, max_states
        self._child: dict[int, int] = {}
        self._open, self._close, self._special = [-1], [-1], {}
        self._memo: dict[int, bool] = {}
        top = 0
        for i, body, closes in pieces:
            node = self._node(body)
            (self._close if closes else self._open)[node] = i
            top = max(top, i)
        for i, body in special:
            self._special[self._node(body)] = i
            top = max(top, i)
        self.length = np.zeros(top + 1, np.int32)
        for i, body, _ in pieces:
            self.length[i] = len(body)
        for i, body in special:
            self.length[i] = len(body)
        _tables.add(self)
        self._clear()

    def _node(self, body: bytes) -> int:
        node = 0
        for b in body:
            nxt = self._child.get(node << 8 | b)
            if nxt is None:
                nxt = self._child[node << 8 | b] = len(self._open)
                self._open.append(-1)
                self._close.append(-1)
            node = nxt
        return node

    def _clear(self) -> None:
        self._keys: list[bytes] = []
        self._index: dict[bytes, int] = {}
        self._column = np.full(256, -1, np.int32)
        self._bytes: list[int] = []
        #: by state and column: next state << _shift | change of the count + _zero; -1 where not made
        self._table = np.empty((1024, 32), np.int32)
        self._shift, self._zero = 8, 128
        self.last = np.full(1024, BOS, np.int32)
        self.final = np.full(1024, BOS, np.int32)
        self._state((0, 0, 0, ((0, BOS, 0, 0),)))

    def _ok(self, left: int, right: int) -> bool:
        """Whether the arc weighs 0; else it weighs infinity."""
        if left == UNKNOWN:
            left = BOS
        code = left + 1 << 32 | right
        found = self._memo.get(code)
        if found is None:
            if len(self._memo) > 250_000:
                self._memo.clear()
            found = self._memo[code] = self._stable(left, right)
        return found

    def _state(self, key) -> int:
        left_over, size, fall, live = key
        packed = array("i", (left_over, size, fall, *(x for item in live for x in item))).tobytes()
        at = self._index.get(packed)
        if at is None:
            at = self._index[packed] = len(self._keys)
            self._keys.append(packed)
            if at >= len(self._table):
                self._table = _rows(self._table, 2 * at, self._table.shape[1], at)
                self.last = np.concatenate([self.last, np.full_like(self.last, BOS)])
                self.final = np.concatenate([self.final, np.full_like(self.final, BOS)])
            self._table[at] = -1
            self.last[at] = live[0][1] if left_over == 0 else BOS
            if self.closing:
                self.final[at] = self._finish(live)[0]
        return at

    def _key(self, at: int):
        flat = array("i")
        flat.frombytes(self._keys[at])
        return flat[0], flat[1], flat[2], tuple(zip(flat[3::4], flat[4::4], flat[5::4], flat[6::4], strict=True))

    def _finish(self, live) -> tuple[int, int]:
        """The closing piece after these bytes, and the change of the count."""
        for node, _, rel, _ in live:
            if node in self._special:
                return self._special[node], rel + 1
        ends = [(w, -rel, piece, rel + 1) for node, left, rel, w in live if node and (piece := self._close[node]) >= 0 and self._ok(left, piece)]
        return min(ends)[2:] if ends else (BOS, 0)

    def _step(self, key, b: int):
        left_over, size, fall, live = key
        if b == RESET:
            return (0, 0, 0, ((0, BOS, 0, 0),)), self._finish(live)[1] if self.closing else 0
        if self.by_char:
            if left_over:
                left_over, size, fall = left_over - 1, size + 1, fall + FALLBACK
            else:  # the path to this position goes on by the character's bytes
                left_over, size, fall = (0 if b < 0xC0 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3), 1, live[0][3] + FALLBACK
        moved, best = [], (fall, UNKNOWN, size) if self.by_char else (1 << 30, UNKNOWN, 0)
        for node, left, rel, w in live:
            nxt = self._child.get(node << 8 | b)
            if nxt is None:
                continue
            moved.append((nxt, left, rel, w))
            if not left_over and w < best[0] and (t := self._open[nxt]) >= 0 and self._ok(left, t):
                best = (w, t, rel + 1)
        if left_over:
            return (left_over, size, fall, tuple(moved)), 0
        weight, piece, made = best
        least = min([weight, *(w for _, _, _, w in moved)])
        return (0, 0, 0, ((0, piece, 0, weight - least), *((n, p, r - made, w - least) for n, p, r, w in moved))), made

    def _fill(self, states, symbols) -> None:
        width = self._table.shape[1]
        for code in np.unique(states.astype(np.int64) * width + symbols).tolist():
            at, col = divmod(code, width)
            if self._table[at, col] < 0:
                key, made = self._step(self._key(at), self._bytes[col])
                to = self._state(key)
                if self._shift == 8 and (to >= 1 << 23 or not -128 <= made <= 127):
                    self._widen()
                self._table[at, col] = to << self._shift | made + self._zero

    def _widen(self) -> None:
        """From 23 bits of a state and 8 of a change to 47 and 16."""
        used = len(self._keys)
        wide = _rows(self._table, *self._table.shape, used, np.int64)
        some = wide[:used]
        wide[:used] = np.where(some < 0, -1, some >> 8 << 16 | (some & 0xFF) - 128 + (1 << 15))
        self._table, self._shift, self._zero = wide, 16, 1 << 15

    def _columns(self, buf):
        for b in np.flatnonzero(np.bincount(buf, minlength=256)).tolist():
            if self._column[b] < 0:
                self._column[b] = len(self._bytes)
                self._bytes.append(b)
        if len(self._bytes) > self._table.shape[1]:
            self._table = _rows(self._table, len(self._table), -(-len(self._bytes) // 8) * 8, len(self._keys))
        return self._column[buf]

    def _advance(self, states, symbols):
        at = states * self._table.shape[1] + symbols
        found = self._table.ravel()[at]
        missing = found < 0
        if missing.any():
            self._fill(states[missing], symbols[missing])
            found = self._table.ravel()[at]
        to = (found >> self._shift).astype(np.int32, copy=False)
        return to, (found & 2 * self._zero - 1) - self._zero

    def run(self, buf: np.ndarray, chunk: int = 256):
        """State after each byte of ``buf``, and the number of pieces up to it."""
        n = len(buf)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self._keys) > self.max_states:
            self._clear()
        lanes = -(-n // chunk)
        padded = np.full(lanes * chunk, RESET, np.uint8)
        padded[:n] = buf
        symbols = np.ascontiguousarray(self._columns(padded).reshape(lanes, chunk).T)
        states, made = np.empty((chunk, lanes), np.int32), np.empty((chunk, lanes), np.int16)
        at = np.zeros(lanes, np.int32)
        for t in range(chunk):
            at, made[t] = self._advance(at, symbols[t])
            states[t] = at
        before = self._enter(symbols, states, made)
        total = before + np.cumsum(made, axis=0, dtype=np.int64)
        return states.T.reshape(-1)[:n], total.T.reshape(-1)[:n]

    def _from(self, lane: np.ndarray, entry: np.ndarray, symbols, states, made):
        """Runs of chunks from entries, until they meet the chunk's run from the start state.

        (states, changes of the count) up to where they meet, this place, exit states, counts.
        """
        chunk, m = len(symbols), len(lane)
        own, change = np.empty((chunk, m), np.int32), np.empty((chunk, m), np.int16)
        meet, live, at = np.full(m, chunk), np.arange(m), entry
        for t in range(chunk):
            at, change[t, live] = self._advance(at, symbols[t, lane[live]])
            own[t, live] = at
            apart = at != states[t, lane[live]]
            meet[live[~apart]] = t + 1
            at, live = at[apart], live[apart]
            if not len(live):
                break
        leaves = states[-1, lane].copy()
        leaves[live] = at
        early = np.arange(chunk)[:, None] < meet
        count = np.where(early, change, made[:, lane]).sum(0, dtype=np.int64)
        return own, change, meet, leaves, count

    def _enter(self, symbols, states, made) -> np.ndarray:
        """Puts the runs from the true entry states into ``states`` and ``made``; the
        number of pieces before each chunk."""
        chunk, lanes = states.shape
        # slots of the state maps: entry, exit and count; slot 0 is the start state
        entries, leaves = np.full((lanes, ROUNDS + 2), -1, np.int64), np.full((lanes, ROUNDS + 2), -1, np.int64)
        counts, size = np.zeros((lanes, ROUNDS + 2), np.int64), np.ones(lanes, np.int64)
        entries[:, 0], leaves[:, 0], counts[:, 0] = 0, states[-1], made.sum(0, dtype=np.int64)
        runs, lane, entry = [], np.arange(1, lanes), states[-1, :-1]
        for _ in range(ROUNDS):
            new = ~(entries[lane] == entry[:, None]).any(1)
            lane, entry = lane[new], entry[new]
            if not len(lane):
                break
            own, change, meet, out, count = self._from(lane, entry, symbols, states, made)
            slot = size[lane]
            entries[lane, slot], leaves[lane, slot], counts[lane, slot] = entry, out, count
            size[lane] += 1
            runs.append((lane, slot, own, change, meet))
            more = lane + 1 < lanes
            lane, entry = lane[more] + 1, out[more]
        # maps between slots of neighbours; -1 where the next chunk's map lacks the state
        after = np.full(leaves.shape, -1, np.int64)
        same = entries[1:, None, :] == leaves[:-1, :, None]
        after[:-1] = np.where(same.any(2) & (leaves[:-1] >= 0), same.argmax(2), -1)
        first, into, before = 0, 0, None
        while first < lanes:
            slot, total = scan(after[first:], counts[first:], into)
            before = total if first == 0 and (slot >= 0).all() else None
            for lane, number, own, change, meet in runs:
                true = (lane >= first) & (slot[np.maximum(lane - first, 0)] == number)
                self._lay(lane[true], own[:, true], change[:, true], meet[true], states, made)
            shut = np.flatnonzero(slot < 0)
            first = first + int(shut[0]) if len(shut) else lanes
            while first < lanes:  # a map that did not close: from the true entry
                known = entries[first] == states[-1, first - 1]
                if known.any():
                    into = int(known.argmax())
                    break
                one = np.array([first])
                own, change, meet, *_ = self._from(one, states[-1, one - 1], symbols, states, made)
                self._lay(one, own, change, meet, states, made)
                first += 1
        return np.append(0, np.cumsum(made.sum(0, dtype=np.int64))[:-1]) if before is None else before

    @staticmethod
    def _lay(lane, own, change, meet, states, made) -> None:
        early = np.arange(len(states))[:, None] < meet
        states[:, lane] = np.where(early, own, states[:, lane])
        made[:, lane] = np.where(early, change, made[:, lane])

    def trace(self, buf: np.ndarray, states: np.ndarray):
        """Ids of the pieces at the position of their first byte, else -1.

        UNKNOWN stands at the first byte of a character that is no piece.
        """
        ids = np.full(len(buf), -1, np.int32)
        stop = np.flatnonzero(buf == RESET) if len(buf) else np.zeros(0, np.int64)
        ends = np.append(stop, len(buf)) - 1
        starts = np.append(0, stop + 1)
        some = ends >= starts
        ends, starts = ends[some].astype(np.int64), starts[some].astype(np.int64)
        lead = None
        if self.by_char:
            lead = np.maximum.accumulate(np.where((buf & 0xC0) != 0x80, np.arange(len(buf)), 0))
        piece = (self.final if self.closing else self.last)[states[ends]]
        while len(ends):
            first = ends - self.length[np.maximum(piece, 0)] + 1
            if lead is not None:
                first = np.where(piece == UNKNOWN, lead[ends], first)
            ids[first] = piece
            on = first > starts
            ends, starts = first[on] - 1, starts[on]
            piece = self.last[states[ends]]
        return ids


def scan(after: np.ndarray, counts: np.ndarray, into: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix scan of maps: map i leads from slot s to slot after[i, s] of map i + 1 (-1:
    to none) and counts counts[i, s].  From slot ``into`` of the first map: the slot in
    which each map is entered, and the sum of what the maps before it count."""
    n = len(after)
    to, total, reach = after.copy(), counts.copy(), 1
    while reach < n:
        first, then = to[:-reach], np.arange(reach, n)[:, None]
        some, via = first >= 0, np.maximum(first, 0)
        to[reach:], total[reach:] = np.where(some, to[then, via], -1), total[:-reach] + np.where(some, total[then, via], 0)
        reach *= 2
    return np.append(into, to[:-1, into]), np.append(0, total[:-1, into])


def merged(symbols: list, rank) -> list:
    """Byte-pair merges: the best pair first, the leftmost of equals.

    ``rank(a, b)``: (order, merged symbol), or None.
    """
    symbols = list(symbols)
    while len(symbols) > 1:
        best = None
        for i in range(len(symbols) - 1):
            r = rank(symbols[i], symbols[i + 1])
            if r is not None and (best is None or r[0] < best[0]):
                best = (r[0], i, r[1])
        if best is None:
            break
        symbols[best[1] : best[1] + 2] = [best[2]]
    return symbols
