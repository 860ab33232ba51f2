"""Encoding and decoding with a SentencePiece model as a transducer (operator 3).

Two weighted transducers are compiled from the model: :class:`Normaliser` (one space in
front, space marks to spaces; other normalisers are refused), and that of
:mod:`automaton` with an arc for each piece and byte-fallback arcs for characters that
no piece has.  Each input is composed with the one and the result with the other, and
the shortest path of the composition in the tropical semiring gives the ids.

In a BPE model the best segmentation is not the one with the largest sum of scores but
the one that the merges make.  So a piece's arc weighs 0 where it and the piece before
stay apart when their concatenation is merged, and infinity elsewhere; fallback arcs weigh
more than 0.  The shortest path equals the library's result.  Composition and search run
lazily, state by state, for all chunks of a batch in step.  Where no piece
goes on from another character into a space, no path depends on what lies before,
and the input is cut there.

Rows: null text counts as empty and has no ids; repeated rows are encoded each; an
empty table gives an empty result; other columns are not read.  A space mark in a
text becomes a space, as in the library.  A very long text is encoded alone, with memory
in proportion to it.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import RESET, UNKNOWN, MergeAutomaton, merged
from .common import documents, sources

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SPAN = 1 << 18
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6


class Normaliser:
    """Byte transducer: ``prefix`` before a text, and its ``replaced`` strings.

    Arcs are (state, byte) -> (state, output); without one for a byte, a state fails to
    that of the longest rest of what it holds and puts out what is before this rest.
    """

    START, BODY = 0, 1

    def __init__(self, prefix: bytes, replaced: dict[bytes, bytes]):
        self.prefix, self.arcs, self.held = prefix, {}, [b"", b""]
        for old, new in replaced.items():
            state = self.BODY
            for k, b in enumerate(old):
                if k == len(old) - 1:
                    self.arcs[state, b] = self.BODY, new
                elif (state, b) in self.arcs:
                    state = self.arcs[state, b][0]
                else:
                    self.held.append(old[: k + 1])
                    self.arcs[state, b] = len(self.held) - 1, b""
                    state = len(self.held) - 1
        # without an arc: what is surely not part of a replaced string, and the state of the rest
        known = {h: k for k, h in enumerate(self.held) if k >= self.BODY}
        self.fails = [next((h[:k], known[h[k:]]) for k in range(min(1, len(h)), len(h) + 1) if h[k:] in known) for h in self.held]
        starts = bytes(b for s, b in self.arcs if s == self.BODY)
        self._leaves = re.compile(b"[" + re.escape(starts) + b"]") if starts else re.compile(b"(?!)")

    def run(self, raw: bytes) -> bytes:
        """The output of the one path through ``raw``."""
        if not raw:
            return b""
        out, state, i = [self.prefix], self.BODY, 0
        while i < len(raw):
            if state == self.BODY:  # loops that copy a byte are taken together
                found = self._leaves.search(raw, i)
                j = found.start() if found else len(raw)
                out.append(raw[i:j])
                i = j
                if i == len(raw):
                    break
            arc = self.arcs.get((state, raw[i]))
            if arc is None:
                done, state = self.fails[state]
                out.append(done)
                continue
            state, made = arc
            out.append(made)
            i += 1
        out.append(self.held[state])
        return b"".join(out)


class PieceVocabulary:
    def __init__(self, path: str, max_states: int = 260_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisers that keep white space are supported")
        self.prefix = b" " if norm.add_dummy_prefix else b""
        self.normaliser = Normaliser(self.prefix, {MARK.encode(): b" "})
        self.shown = [b""] * len(model.pieces)
        self._body, order, self._byte = {}, {}, np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self._body[i] = self.shown[i] = p.piece.replace(MARK, " ").encode()
                order[self._body[i]] = -p.score
            elif p.type == BYTE:
                b = int(p.piece[3:5], 16)
                self._byte[b], self.shown[i] = i, bytes([b])
            elif p.type == UNK:
                self.shown[i] = " ⁇ ".encode()
            elif p.type != CONTROL:
                raise ValueError(f"pieces of type {p.type} are not supported")
        if any(c.encode() not in order for body in self._body.values() for c in body.decode()):
            raise ValueError("a piece has a character that is no piece")
        self._cut_at_space = not any(a != 32 and b == 32 for body in self._body.values() for a, b in zip(body, body[1:], strict=False))

        def rank(a: bytes, b: bytes):
            found = order.get(a + b)
            return None if found is None else (found, a + b)

        self._rank = rank
        pieces = [(i, body, False) for i, body in self._body.items()]
        self.automaton = MergeAutomaton(pieces, self._stable, by_char=True, max_states=max_states)

    def _stable(self, left: int, right: int) -> bool:
        both = [self._body[p] for p in ([right] if left < 0 else [left, right])]
        return merged([c.encode() for body in both for c in body.decode()], self._rank) == both

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for t in texts:
            held.append(self.normaliser.run(t.encode()))
            size += len(held[-1])
            if size > SPAN:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held) if held else out

    def _encode(self, raw: list[bytes]) -> list[np.ndarray]:
        stop = bytes([RESET])
        data = np.frombuffer(stop.join(raw) + stop, np.uint8)
        begin = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
        if self._cut_at_space:
            cut = np.zeros(len(data), bool)
            cut[1:] = (data[1:] == 32) & (data[:-1] != 32) & (data[:-1] != RESET)
            at = np.arange(len(data)) + np.cumsum(cut)
            buf = np.full(len(data) + int(cut.sum()), RESET, np.uint8)
            buf[at] = data
            begin = np.append(at[begin[:-1]], len(buf))
        else:
            buf = data
        states, _ = self.automaton.run(buf)
        ids = self.automaton.trace(buf, states)
        lead = np.maximum.accumulate(np.where((buf & 0xC0) != 0x80, np.arange(len(buf)), 0))
        unknown = (ids == UNKNOWN)[lead]
        ids[unknown] = self._byte[buf[unknown]]
        some = ids >= 0
        before = np.append(0, np.cumsum(some))
        return np.split(ids[some].astype(np.int32), before[begin[1:-1]])

    def decode(self, ids) -> str:
        raw = b"".join([self.shown[i] for i in ids])
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@functools.cache
def piece_vocabulary(path: str) -> PieceVocabulary:
    """One for each process; Spark reuses Python workers."""
    return PieceVocabulary(path)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row."""
    path, rows = model or public_tokenizers.path(MODEL), sources(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = piece_vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vocab.encode(batch.column(1).to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    path = model or public_tokenizers.path(MODEL)
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = piece_vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocab.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Sizes and digests of each row's ids and of the text decoded from them."""
    path, rows = model or public_tokenizers.path(MODEL), sources(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = piece_vocabulary(path)
        for batch in batches:
            out = []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, vocab.encode(texts), strict=True):
                back = vocab.decode(ids.tolist())
                out.append((len(text.encode()), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(MARK, " ")))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], ["doc_id", "n_bytes", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
