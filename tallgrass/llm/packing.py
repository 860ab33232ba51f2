"""Best-fit-decreasing packing of token sequences (operator 6).

Best-fit decreasing places documents from the longest to the shortest, each in
the open bin with the least room that still takes it.  Only lengths matter for
that, and there are at most ``capacity`` of them, so the whole corpus is packed
from its histogram of lengths: bins with the same room are one entry, a segment
tree over the rooms finds the tightest entry in logarithmic time, and all
documents of one length that go into bins of one entry are placed at once.  The
plan has a size that depends on ``capacity`` alone, not on the corpus.

1. Documents are tokenized once; pieces and their number within their task and
   length are staged.
2. Counts by (task, length) become the first number of each task within each
   length, joined to the pieces: a piece's number within its length is known
   without sorting or gathering any length.
3. The plan turns (length, number) into a sequence and an offset.

Rows: null text counts as empty; every document has its closing id, so an empty
one is a piece of length 1.  Repeated rows are packed each.  An empty table gives
an empty result.  Documents beyond ``capacity`` are cut into full pieces and a rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, sources, staged
from .wordvocab import word_vocabulary

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0


class TightestFit:
    """Segment tree over rooms 0..capacity: which rooms have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, room: int, some: bool) -> None:
        at = self.size + room
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def at_least(self, room: int) -> int | None:
        """The smallest room of this size or more that has an open bin."""
        at = self.size + room
        while not self.some[at]:
            while at & 1:  # a right child: go up
                at //= 2
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return None
        while at < self.size:
            at *= 2
            if not self.some[at]:
                at += 1
        return at - self.size


@dataclass
class Plan:
    """Runs of placements: number ``first`` and on of ``length`` go to bins
    ``sequence`` and on, ``each`` to a bin, the first at ``offset``."""

    capacity: int
    n_sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def arrays(self):
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return runs[:, 0] * (1 << 44) + runs[:, 1], runs

    def place(self, key, runs, length, number):
        """Sequence and offset of pieces, from what ``arrays`` returned."""
        run = runs[np.searchsorted(key, length * (1 << 44) + number, side="right") - 1]
        k = number - run[:, 1]
        return run[:, 2] + k // run[:, 4], run[:, 3] + k % run[:, 4] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over counts of lengths."""
    out, tree = Plan(capacity), TightestFit(capacity)
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, number of bins)

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        while left:
            room = tree.at_least(length)
            if room is None:  # new bins, as many as this length needs
                room = capacity
                each = room // length
                first, n = out.n_sequences, -(-left // each)
                out.n_sequences += n
            else:
                each = room // length  # the bin just used has become the tightest
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            out.runs.append((length, number, first, capacity - room, each))
            rest = placed - (used - 1) * each
            put(room - each * length, first, used - (rest < each))
            if rest < each:
                put(room - rest * length, first + used - 1, 1)
            put(room, first + used, n - used)
            number, left = number + placed, left - placed
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenized pieces: id, piece, start, length, ids_crc32, task, nth."""
    rows = sources(docs, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen, task = word_vocabulary(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            at, out = [], []
            for i, ids in enumerate(vocab.ids(batch.column(1).to_pylist())):
                raw = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                for k, start in enumerate(range(0, len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    at.append(i)
                    out.append((k, start, length, zlib.crc32(own), task, seen[length]))
                    seen[length] += 1
            table = np.array(out, np.int64).reshape(-1, 6)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, c]) for c in range(1, 6))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its offset there."""
    cut = staged(pieces(docs, vocabulary or public_tokenizers.path(VOCABULARY), capacity, end_id), "pieces")
    by_task = staged(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    packed = plan(histogram, capacity)
    key, runs = packed.arrays()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = packed.place(key, runs, length, number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
