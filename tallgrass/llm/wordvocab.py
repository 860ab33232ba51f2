"""The word-end byte-pair vocabulary (``word_bpe_49k.json``) as a transducer.

Texts go through the file's normaliser (NFC, white space to one space, lower
case) and word pattern as array operations over whole batches, then through the
merge transducer of :mod:`automaton`.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from .automaton import RESET, MergeAutomaton, merged

#: Unicode White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters that are lexed and run together: arrays of this length stay in cache.
SPAN = 1 << 18
OTHER, LETTER, NUMBER, MARK, SPACE = 0, 1, 2, 3, 4


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        table[cp] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[SPACES] = SPACE
    table[0xD800:0xE000] = MARK
    return table


class WordVocabulary:
    def __init__(self, path: str, max_states: int = 260_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or not suffix:
            raise ValueError("not a lower-case vocabulary with word ends")
        ranks = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocab[a], vocab[b]] = (i, vocab[a + b])
        letters = _byte_letters()
        shown = {b: u for u, b in letters.items()}
        self._single = [vocab[shown[b]] for b in range(256)]
        self._single_end = [vocab[shown[b] + suffix] for b in range(256)]
        marks = {x["content"]: x["id"] for x in spec["added_tokens"]}
        #: special strings, each replaced by a code point that no text can hold
        self._marks = {s: (i, chr(0xD800 + k)) for k, (s, i) in enumerate(marks.items())}
        self._body, pieces = {}, []
        for s, i in vocab.items():
            if s in marks:
                continue
            closes = s.endswith(suffix) and s != suffix
            body = bytes(letters[c] for c in (s[: -len(suffix)] if closes else s))
            pieces.append((i, body, closes))
            self._body[i] = (body, closes)
        self._rank = lambda a, b: ranks.get((a, b))
        special = [(i, m.encode("utf-8", "surrogatepass")) for i, m in self._marks.values()]
        self.automaton = MergeAutomaton(pieces, self._stable, closing=True, special=special, max_states=max_states)

    def _symbols(self, piece: int) -> list[int]:
        body, closes = self._body[piece]
        out = [self._single[b] for b in body]
        if closes:
            out[-1] = self._single_end[body[-1]]
        return out

    def _stable(self, left: int, right: int) -> bool:
        both = [right] if left < 0 else [left, right]
        return merged([s for p in both for s in self._symbols(p)], self._rank) == both

    def _normal(self, text: str) -> str:
        if "<|" in text:
            for s, (_, mark) in self._marks.items():
                text = text.replace(s, mark)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def symbols(self, texts: list[str]):
        """Bytes of all words, RESET after each; and where each text's start."""
        texts = [self._normal(t) for t in texts]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        whole = "\n".join(texts) + "\n" if texts else ""
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        kind = _classes()[cps]
        ends = kind != SPACE
        ends[:-1] &= (kind[:-1] != kind[1:]) | (kind[:-1] >= NUMBER)
        self._contractions(cps, kind, ends)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(raw)))
        keep = np.repeat(kind != SPACE, width)
        closes = np.zeros(len(raw), bool)
        closes[(lead + width - 1)[ends]] = True
        at = np.cumsum(keep.astype(np.int8) + closes, dtype=np.int32)
        out = np.full(int(at[-1]) if len(at) else 0, RESET, np.uint8)
        out[(at - 1 - closes)[keep]] = raw[keep]
        first = np.append(0, np.cumsum(sizes))[:-1]
        begin = lead[first] if len(first) else first
        return out, np.append(0, at)[begin], len(out)

    @staticmethod
    def _contractions(cps, kind, ends) -> None:
        """'s 't 'm 'd 're 've 'll at the start of a word are words."""
        n = len(cps)
        at = np.flatnonzero(cps == 0x27)
        if not len(at):
            return
        at = at[(at == 0) | (kind[np.maximum(at, 1) - 1] != OTHER)]
        a = cps[np.minimum(at + 1, n - 1)]
        b = cps[np.minimum(at + 2, n - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        ends[at[one | two]] = False
        ends[at[one] + 1] = True
        ends[at[two] + 2] = True
        ends[at[two] + 1] = False

    def _spans(self, texts):
        """Slices of at most a few megabytes."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > SPAN:
                yield first, i + 1
                first, size = i + 1, 0
        if first < len(texts):
            yield first, len(texts)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for a, b in self._spans(texts):
            buf, begin, n = self.symbols(texts[a:b])
            total = np.append(0, self.automaton.run(buf)[1])
            out[a:b] = total[np.append(begin[1:], n)] - total[begin]
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        out = []
        for a, b in self._spans(texts):
            buf, begin, n = self.symbols(texts[a:b])
            states, _ = self.automaton.run(buf)
            at = self.automaton.trace(buf, states)
            some = at >= 0
            ids = at[some].astype(np.uint32)
            before = np.append(0, np.cumsum(some))
            out += np.split(ids, before[begin[1:]])
        return out


@functools.cache
def word_vocabulary(path: str) -> WordVocabulary:
    """One for each process; Spark reuses Python workers."""
    return WordVocabulary(path)
