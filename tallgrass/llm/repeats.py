"""Removal of long repeated byte strings by a run-length index (operator 4).

A byte goes when a LENGTH-byte string that covers it also starts elsewhere, in its
own or another text.

1. Texts that are equal as a whole are one text here: each of them goes as a whole
   if it has LENGTH bytes.  All else is found on one of each.
2. Equal strings have equal anchors (:mod:`anchors`), so they meet in the group of
   an anchor's hash, aligned at the anchor.  Of windows that are equal as a whole, told
   by a hash, two take part for all.
3. Each group's windows are indexed by a run-compressed positional Burrows-Wheeler
   transform (:class:`RunIndex`): at every column, from the last to the first, the
   transform's bytes are stored as runs, each with its place in the next column's order
   and, sampled at its two ends, the match there with the neighbour.  Windows are then
   streamed through the runs: a window's place follows from its run, inside a run its
   matches with both neighbours grow by one, at run ends they are the samples.  These
   are the matching statistics of every start; starts that reach LENGTH are marked.
   Many groups are indexed in one batch.
4. Groups of more than BLOCK windows would need one large index.  They are parted by
   ranges of starts (:func:`split`): strings that start in one range and are equal
   share the bytes that all strings of the range have, its core, so windows with
   another core part.  Of windows that are equal over the range, which repeat there,
   one takes part for all.  Groups of BLOCK or fewer that are left go to the index, the
   others to narrower ranges, of one start at last.  So a window sends a few rows a
   level, and the work is linear in the number of windows.
5. Marked ranges return to all texts with that window and are united there.

Hashes are of 64 bits (anchors and windows, cores and ranges: 128 together) and of 256 bits
(texts); a marked start is a true repetition unless two of them collide.

Rows: null text counts as empty; texts below LENGTH bytes stay whole; repeated rows
are repetitions of each other; an empty table gives an empty result; other columns
are not read.  Very long texts are handled one at a time, in linear space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, LENGTH, anchors
from .common import documents, scratch, sources, staged
from .ngrams import _BACK, _BASE, _BYTE, _powers, mix

SIDE = LENGTH - GRAM
BLOCK = 256
#: Windows that are indexed together.
BATCH = 4096
#: Starts in the ranges by which large groups are parted, each a multiple of the next.
WIDTHS = (40, 8, 1)


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair, by powers of two."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        own = level == k
        if own.any():
            out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
        table = np.minimum(table[: max(0, len(table) - (1 << k))], table[1 << k :]) if len(table) > 1 << k else table[:0]
    return out


class RunIndex:
    """Positional Burrows-Wheeler transform of grouped windows, in runs.

    ``sides``: the windows without their gram, symbols row by row.  For each column from
    the last to the first: first place, length, next place, and match with the window
    before the run and behind it in the next order.  A group keeps its range of places.
    """

    def __init__(self, sides: np.ndarray, group: np.ndarray):
        n = len(sides)
        order = np.argsort(group, kind="stable")
        self.first = order
        fresh = np.append(True, group[order][1:] != group[order][:-1])
        self.head, self.tail = fresh, np.append(fresh[1:], True)
        own_group, match = np.cumsum(fresh), np.zeros(n, np.int64)  # match: with the window before
        self.columns = []
        for column in range(2 * SIDE - 1, -1, -1):
            if column == SIDE - 1:
                match = np.where(fresh, 0, match + GRAM)  # the gram is the same for all
            symbol = sides[order, column]
            run = np.append(True, (symbol[1:] != symbol[:-1]) | fresh[1:])
            start = np.flatnonzero(run)
            length = np.diff(np.append(start, n))
            by = np.lexsort((symbol[start], own_group[start]))
            to = np.empty(len(start), np.int64)
            to[by] = np.cumsum(length[by]) - length[by]
            before, after = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            same = np.flatnonzero((symbol[start[by]][1:] == symbol[start[by]][:-1]) & (own_group[start[by]][1:] == own_group[start[by]][:-1])) + 1
            if len(same):
                ends = start[by[same - 1]] + length[by[same - 1]]
                before[by[same]] = range_minima(match, ends, start[by[same]]) + 1
                after[by[same - 1]] = before[by[same]]
            self.columns.append((start, length, to, before, after))
            place = np.repeat(to - start, length) + np.arange(n)
            order, match = _put(order, place), _put(np.where(run, np.repeat(before, length), match + 1), place)

    def marks(self) -> np.ndarray:
        """Which starts, SIDE columns before the gram or at it, match another window of
        the group for LENGTH symbols or more, by the windows' matching statistics."""
        n = len(self.first)
        place, before, after = np.empty(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        place[self.first] = np.arange(n)
        out = np.zeros((n, SIDE + 1), bool)

        def gram():
            before[~self.head[place]] += GRAM
            after[~self.tail[place]] += GRAM
            out[:, SIDE] = np.maximum(before, after) >= LENGTH

        for column, (start, length, to, head, tail) in zip(range(2 * SIDE - 1, -1, -1), self.columns, strict=True):
            if column == SIDE - 1:
                gram()
            run = np.searchsorted(start, place, side="right") - 1
            within = place - start[run]
            before = np.where(within == 0, head[run], before + 1)
            after = np.where(within == length[run] - 1, tail[run], after + 1)
            place = to[run] + within
            if column < SIDE:
                out[:, column] = np.maximum(before, after) >= LENGTH
        if not SIDE:
            gram()
        return out


def _put(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[place] = values
    return out


def split(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of windows, one for each range of ``width`` starts.

    A window, without its gram, is what is left and right of it; its strings start at
    SIDE - size(left) to size(right).  A part is the window of its own strings alone,
    with a hash of its core (with gram and range) and one of itself.
    """
    for batch in batches:
        out = []
        for gram, window, twice, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle, first, last = len(left), SIDE - len(left), min(SIDE, len(right))
            data = np.frombuffer(left + right, np.uint8)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=total[1:])
            back = _powers(_BACK, len(data) + 1)
            low = np.arange(first // width * width, last + 1, width)
            high = np.minimum(low + width, SIDE + 1) - 1
            begin, end = np.maximum(low, first), np.minimum(high, last)
            of = lambda x, y: mix((total[y] - total[x]) * back[x])  # noqa: B023, E731
            core = mix(mix(of(middle - SIDE + high, middle + low) + low.astype(np.uint64)) + np.array(gram).astype(np.uint64))
            own = mix(of(middle - SIDE + begin, middle + end) + (begin * (SIDE + 1) + end).astype(np.uint64))
            for c, o, x, y in zip(core.view(np.int64).tolist(), own.view(np.int64).tolist(), begin.tolist(), end.tolist(), strict=True):
                out.append((c, o, gram, window, twice, x, y, left[middle - SIDE + x :], right[:y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PART, strict=True)], schema=PART)


def ranges(marks: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of True."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1)


def digests(docs: DataFrame) -> DataFrame:
    """Staged: doc_id, at, digest, n_bytes and anchors (hash, window, position, extent)."""
    rows = sources(docs, "doc_id").select("doc_id", F.monotonically_increasing_id().alias("at"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, found = [], [], []
            for text in batch.column(2).cast(pa.large_binary()):
                raw = text.as_py()
                at, value, window, first, last = anchors(np.frombuffer(raw, np.uint8))
                digest.append(hashlib.sha256(raw).digest())
                size.append(len(raw))
                found.append(np.stack([value, window, at, (at - first) * (1 << 32) + last - at], 1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "at", "digest", "n_bytes", "anchors"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(find, f"doc_id {kind}, at long, digest binary, n_bytes long, anchors array<long>"), "anchors")


def with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with ``packed``, the text that has their identifier and digest,
    compressed for the shuffle.  Copies of a text are apart by their identifiers."""
    texts = packed_texts(docs)
    same = rows["doc_id"].eqNullSafe(texts["own_id"]) & (rows["digest"] == texts["own_digest"])
    return rows.join(texts, same).drop("own_id", "own_digest")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(own_id, own_digest, packed) of the texts that are long enough."""
    rows = sources(docs, "doc_id").where(F.octet_length("text") >= LENGTH)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            raw = [x.as_py() for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array([codec.compress(r) for r in raw], pa.binary())], ["own_id", "own_digest", "packed"])

    return rows.mapInArrow(pack, f"own_id {rows.schema['doc_id'].dataType.simpleString()}, own_digest binary, packed binary")


def marked_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Staged: at, from, to: bytes of texts (one of each) that are covered by repetitions."""
    with scratch(docs.sparkSession):
        return staged(_marked_ranges(docs, found), "ranges", last=True)


def _marked_ranges(docs: DataFrame, found: DataFrame) -> DataFrame:
    one = found.where("size(anchors) > 0").groupBy("digest").agg(F.min("at").alias("at"))
    anchored = found.join(one.select("at"), "at", "left_semi").select("at", "doc_id", "digest", F.explode(F.expr("transform(sequence(0, size(anchors) div 4 - 1), i -> struct(anchors[4 * i] AS gram, anchors[4 * i + 1] AS window, anchors[4 * i + 2] AS pos, anchors[4 * i + 3] div 4294967296 AS before, anchors[4 * i + 3] % 4294967296 AS after))")).alias("a"))
    rows = staged(anchored.select("at", "doc_id", "digest", "a.*"), "anchor-rows")
    windows = rows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "doc_id", "digest", "pos", "before", "after")).alias("first"))
    windows = staged(windows, "windows")
    groups = windows.groupBy("gram").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_places")).where("n_places > 1")
    hot = F.col("n_windows") > BLOCK
    wanted = windows.join(groups, "gram").select("first.doc_id", "first.digest", F.struct("gram", "window", F.col("first.pos").alias("pos"), F.col("first.before").alias("before"), F.col("first.after").alias("after"), (F.col("n") > 1).alias("twice"), hot.alias("hot")).alias("w"))
    by_text = wanted.groupBy("doc_id", "digest").agg(F.collect_list("w").alias("wanted"))
    texts = with_texts(by_text, docs).select("wanted", "packed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a repeated row brings its windows twice: they are repetitions
        codec, out = zstandard.ZstdDecompressor(), []
        for batch in batches:
            for wanted, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = codec.decompress(packed)
                for w in wanted:
                    left, right = raw[w["pos"] - w["before"] : w["pos"]], raw[w["pos"] + GRAM : w["pos"] + w["after"]]
                    out.append((w["gram"], w["window"], w["twice"], w["hot"], left, right))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), WINDOW, strict=True)], schema=WINDOW)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), WINDOW, strict=True)], schema=WINDOW)

    pieces = staged(texts.mapInArrow(cut, "gram long, window long, twice boolean, hot boolean, left binary, right binary"), "window-strings")
    small, marked = parted(pieces.where("hot").drop("hot"))
    small = pieces.where("NOT hot").select(F.col("gram").alias("part"), "gram", "window", "twice", "left", "right").unionByName(small)
    indexed = small.repartition("part").sortWithinPartitions("part").mapInArrow(index, "gram long, window long, first int, last int")
    # staged, so that a hot window's places can be split or its marks be broadcast, as their size allows
    marks = staged(indexed.unionByName(marked).groupBy("gram", "window").agg(F.collect_set(F.struct("first", "last")).alias("e")), "marks")
    marks = rows.select("gram", "window", "at", "pos", "before", "after").join(marks, ["gram", "window"]).select("at", "pos", "before", "after", F.explode("e").alias("e")).select("at", "pos", "before", "after", "e.*")
    # a window that occurs again counts from end to end
    return marks.select("at", (F.col("pos") - F.least(F.col("before"), SIDE - F.col("first"))).alias("from"), (F.col("pos") + F.least(F.col("after"), GRAM + F.col("last"))).alias("to"))


def parted(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts for the index (part, gram, window, twice, left, right), and starts of
    ``windows`` (of large groups) that are marked already (gram, window, first, last)."""
    spark = windows.sparkSession
    small = spark.createDataFrame([], "part long, gram long, window long, twice boolean, left binary, right binary")
    marked = spark.createDataFrame([], "gram long, window long, first int, last int")
    for width in WIDTHS:
        if windows.isEmpty():
            break
        with scratch(spark):
            parts = staged(windows.mapInArrow(partial(split, width=width), "core long, own long, gram long, window long, twice boolean, first int, last int, left binary, right binary"), "parts")
            ones = parts.groupBy("core", "own").agg(F.count(F.lit(1)).alias("n"), F.bool_or("twice").alias("twice"), F.min(F.struct("window", "gram", "left", "right")).alias("one"))
            ones = staged(ones, "different-parts")
            again = ones.where("n > 1 OR twice").select("core", "own")
            found = parts.select("core", "own", "gram", "window", "first", "last").join(again, ["core", "own"]).select("gram", "window", "first", "last")
            marked = marked.unionByName(staged(found, "repeated-parts", last=True))
            cores = ones.groupBy("core").agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")
            left = staged(ones.join(cores, "core").select(F.col("core").alias("part"), "one.gram", "one.window", F.lit(False).alias("twice"), "one.left", "one.right", "n_parts"), "open-parts", last=True)
        small = small.unionByName(left.where(F.col("n_parts") <= BLOCK).drop("n_parts"))
        windows = left.where(F.col("n_parts") > BLOCK).select("gram", "window", "twice", "left", "right")
    return small, marked


WINDOW = pa.schema([("gram", pa.int64()), ("window", pa.int64()), ("twice", pa.bool_()), ("hot", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
PART = pa.schema([("core", pa.int64()), ("own", pa.int64()), ("gram", pa.int64()), ("window", pa.int64()), ("twice", pa.bool_()), ("first", pa.int32()), ("last", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked starts of the windows of whole groups, about BATCH windows at a time."""
    held, size = [], 0

    def flush(table: pa.Table):
        n = table.num_rows
        if not n:
            return
        if pc.any(table.column("twice")).as_py():  # of equal windows two take part
            table = table.take(np.repeat(np.arange(n), 1 + table.column("twice").to_numpy()))
            n = table.num_rows
        part, group, windows = (table.column(c).to_numpy() for c in ("part", "gram", "window"))
        sides = np.empty((n, 2 * SIDE), np.int32)
        sides[:] = 256 + np.arange(n)[:, None]  # beyond a text's end nothing matches
        for c, name in ((0, "left"), (1, "right")):
            for i, raw in enumerate(table.column(name).to_pylist()):
                at = SIDE - len(raw) if c == 0 else SIDE
                sides[i, at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        found = RunIndex(sides, part).marks()
        out = [(group[i], windows[i], f, t) for i in np.flatnonzero(found.any(1)) for f, t in ranges(found[i])]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["gram", "window", "first", "last"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH:
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            open_from = int(np.searchsorted(part, part[-1]))  # the last group may go on in the next batch
            if open_from:
                yield from flush(table.slice(0, open_from))
                held = table.slice(open_from).combine_chunks().to_batches()
                size -= open_from
    if held:
        yield from flush(pa.Table.from_batches(held))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Staged: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row."""
    with scratch(docs.sparkSession):
        return staged(_remove_repeats(docs).withColumn("removed", F.col("n_removed") > 0), "kept-parts", last=True)


def _remove_repeats(docs: DataFrame) -> DataFrame:
    found = digests(docs)
    spans = marked_ranges(docs, found).groupBy("at").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    copies = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    alone = found.join(copies, "digest").select("doc_id", "at", "digest", "n_bytes", "n", "first")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    partly = alone.where(~whole).join(spans, "at").select("doc_id", "digest", "n_bytes", "spans")
    rest = alone.join(spans.select("at"), "at", "left_anti").where(~whole).unionByName(alone.where(whole))
    plain = rest.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, size, spans, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edge = np.zeros(size + 1, np.int64)
                for s in spans:
                    edge[s["from"]] += 1
                    edge[min(s["to"], size)] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                raw = np.frombuffer(codec.decompress(packed), np.uint8)
                kept = raw[~gone].tobytes()
                out.append((doc_id, size, int(gone.sum()), len(ranges(gone)), hashlib.sha256(kept).hexdigest()))
            if out:
                ids, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c) for c in columns)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    joined = with_texts(partly, docs).select("doc_id", "n_bytes", "spans", "packed")
    return plain.unionByName(joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
