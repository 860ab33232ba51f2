"""Similarity join on word n-grams with Bayesian candidate pruning (operator 2).

Two texts are linked when the Jaccard similarity of their sets of SHINGLE-word
runs is THRESHOLD or more.

1. Every row becomes a set of hashed shingles and the band keys of its MinHash
   signature, staged without the text.  Rows with the same set are one class, whatever
   their identifiers, with one of them to represent it; copies are never compared.
2. Signatures are cut into BANDS bands of ROWS values.  A pair at the threshold
   shares no band with probability (1 - t**ROWS)**BANDS, about 1e-7.  Classes that
   share a band are candidates.
3. A class is at home with the first class that it reaches over two bands; the
   classes of one home are dealt into blocks of about BLOCK classes or WEIGHT shingles.
   Two blocks meet if a band is in both, once, whatever the number of such bands.  So
   near copies meet in one home, and texts tied by a chain of bands do not all meet.
4. In a meeting, signatures are compared STEP values at a time; a pair is dropped
   once the posterior probability that its similarity reaches the threshold, under a
   uniform prior, is below TOLERANCE.  What is left is verified on the shingle sets.  For
   these the candidates' texts are read again, and each set is made once for every
   MEETINGS meetings of its class.
5. Meetings return, for each class, its number of links and a forest of the links
   they found, never pairs; components of the forests are the result's classes.

Shingles are 64-bit hashes, so the verification is exact unless two of them
collide.  Words are runs without white space, case kept.  A text of fewer words
than a shingle has one shingle of all its words.

Rows: null, empty and blank texts have no shingles, so no links, and are a class
of their own each, with their own identifier; a row with a null identifier or with
another row's identifier is a document of its own like any other, and a class
of null identifiers only has a null class_id; repeated rows are copies; ties in size
go to the larger band key; an empty table gives an empty result; other columns are
not read.  A very long text is hashed alone, with memory in proportion to it.  Rows
that are not the same when read again raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .automaton import release
from .common import documents, fresh, likely, located, scratch, sources, staged, text_of
from .components import components
from .ngrams import ngram_hashes, slices, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS, STEP = 5, 40, 40
TOLERANCE = 1e-6
BLOCK, WEIGHT = 1024, 1 << 19
#: Meetings for which a class is sent and shingled once.
MEETINGS = 64

_rng = np.random.default_rng(8191)
_A = _rng.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for first, last, data, starts in slices(texts):
        words, text = word_hashes(data, starts)
        grams, of = ngram_hashes(words, text, SHINGLE, whole_if_short=True)
        for own in np.split(grams, np.searchsorted(of, np.arange(1, last - first))):
            yield np.unique(own)


def signature(shingles: np.ndarray) -> np.ndarray:
    """ROWS * BANDS MinHash values of 32 bits."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[k : k + 2048, None] * _A + _B).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    raw = sign.reshape(BANDS, ROWS).astype("<u4")
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]) + r.tobytes(), digest_size=8).digest(), "little", signed=True) for b, r in enumerate(raw)], np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest equal ones with which a pair stays.

    With a uniform prior and m of n equal, the similarity is Beta(m+1, n-m+1), and
    P(similarity >= t) = P(Binomial(n+1, t) <= m).
    """
    out = {}
    for n in range(STEP, ROWS * BANDS + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def links(sets: list[np.ndarray], signs: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked js) between the classes ``left`` and ``right``, or within left."""
    sizes = np.array([len(s) for s in sets])
    least = least_matches()
    for k, i in enumerate(left):
        js = left[k + 1 :] if right is None else right
        # similarity cannot reach the threshold when one set is much smaller
        js = js[np.minimum(sizes[js], sizes[i]) >= THRESHOLD * np.maximum(sizes[js], sizes[i]) - 1e-9]
        equal = np.zeros(len(js), np.int64)
        for n, m in least.items():
            if not len(js):
                break
            equal = equal + (signs[js, n - STEP : n] == signs[i, n - STEP : n]).sum(1)
            js, equal = js[equal >= m], equal[equal >= m]
        if not len(js):
            continue
        own, other = sets[i], np.concatenate([sets[j] for j in js])
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        both = np.add.reduceat((own[at] == other).astype(np.int64), np.append(0, np.cumsum(sizes[js])[:-1]))
        js = js[both * 10_000 >= round(THRESHOLD * 10_000) * (sizes[js] + sizes[i] - both)]
        if len(js):
            yield i, js


def compared(members: list[tuple[int, int, bool, np.ndarray]], both: bool) -> dict[int, list[int]]:
    """Links of a meeting: between its two blocks, or inside its only one.

    ``members``: (class, copies, whether of the first block, signature and shingles).
    For each class with links: number of linked texts, number of their documents,
    smallest class it is linked to here.
    """
    ids = [m[0] for m in members]
    copies = np.array([m[1] for m in members], np.int64)
    signs = np.stack([m[3][: len(_A) // 2].view(np.uint32) for m in members])
    sets = [m[3][len(_A) // 2 :] for m in members]
    left = np.array([m[2] for m in members])
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    texts, docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for i, js in links(sets, signs, np.flatnonzero(left), np.flatnonzero(~left) if both else None):
        texts[i] += len(js)
        docs[i] += copies[js].sum()
        texts[js] += 1
        docs[js] += copies[i]
        for j in js:
            x, y = root(i), root(int(j))
            if x != y:  # the smaller one is the root
                x, y = (x, y) if ids[x] < ids[y] else (y, x)
                parent[y] = x
    return {ids[k]: [int(texts[k]), int(docs[k]), ids[root(k)]] for k in np.flatnonzero(texts)}


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, 128 bits of a digest of text and identifier, by which a text is found again."""
    own = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    return rows.withColumn("key", F.unhex(F.substring(F.sha2(F.concat(F.sha2("text", 256), own), 256), 1, 32)))


def sketched(rows: DataFrame) -> DataFrame:
    """Staged: at, doc_id, set_id (digest of the shingle set, null if empty), size,
    bands and other columns of rows (at, doc_id, text, ...)."""
    others = rows.columns[3:]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            digests, sizes, bands = [], [], []
            for s in shingle_sets(batch.column(2)):
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                bands.append(band_keys(signature(s)) if len(s) else None)
            columns = [pa.array(c, t) for c, t in ((digests, pa.binary()), (sizes, pa.int64()), (bands, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != 2), *columns], ["at", "doc_id", *others, "set_id", "size", "bands"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("at", "doc_id", *others))
    return staged(rows.mapInArrow(sketch, f"{kept}, set_id binary, size long, bands array<long>"), "signatures")


def classes(sketches: DataFrame) -> DataFrame:
    """Staged: class (of the rows with a set the one with the smallest identifier),
    key, set_id, first_id (this identifier), copies, size, bands."""
    own = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at", "key", "size", "bands")).alias("own")
    sets = sketches.where("set_id IS NOT NULL").groupBy("set_id").agg(own, F.count(F.lit(1)).alias("copies"))
    return staged(sets.select(F.col("own.at").alias("class"), "own.key", "set_id", F.col("own.doc_id").alias("first_id"), "copies", "own.size", "own.bands"), "sets")


def blocks(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: (class, key, copies, block) of the candidates, and (block, a, b): its meetings."""
    banded = sets.select("class", F.explode("bands").alias("band"))
    # one shuffle of the bands, not one to count them and one to join
    own = Window.partitionBy("band")
    counted = banded.select("class", "band", F.min("class").over(own).alias("first"), F.count(F.lit(1)).over(own).alias("n"))
    ties = staged(counted.where("n > 1").drop("n"), "bands")
    # twice, so that a member of a large group that misses its first class comes to its home as well
    near = ties.groupBy("class").agg(F.min("first").alias("home"))
    by_band = ties.join(near, "class").groupBy("band").agg(F.min("home").alias("home"))
    homes = ties.select("class", "band").join(by_band, "band").groupBy("class").agg(F.min("home").alias("home")).join(sets.select("class", "key", "copies", "size"), "class")
    homes = staged(homes, "homes")
    full = homes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / WEIGHT)).alias("n_blocks"))
    placed = staged(homes.join(full, "home").select("class", "key", "copies", F.xxhash64("home", F.pmod(F.xxhash64("class"), "n_blocks")).alias("block")), "blocks")
    inside = ties.join(placed.select("class", "block"), "class").select("band", "block").distinct()
    several = staged(inside.groupBy("band").agg(F.collect_set("block").alias("blocks")).where("size(blocks) > 1"), "block-bands")
    # blocks of a band, not its texts: BLOCK times fewer
    ordered = several.select(F.array_sort("blocks").alias("blocks")).distinct()
    meetings = ordered.select("blocks", F.posexplode("blocks").alias("i", "a")).select("a", F.explode(F.expr("slice(blocks, i + 2, size(blocks))")).alias("b")).distinct()
    meetings = staged(meetings, "meetings")
    alone = placed.groupBy(F.col("block").alias("a"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = meetings.select(F.col("a").alias("block"), "a", "b").union(meetings.select(F.col("b").alias("block"), "a", "b"))
    return placed, both.union(alone.select(F.col("a").alias("block"), "a", "b"))


def packed_texts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(key, packed): texts of ``rows`` that ``members`` may want, one for each key."""
    # a bitmap first, so that only the candidates' texts are shuffled
    texts = likely(rows.select("key", "text"), ["key"], members, "candidate").where("candidate").select("key", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [codec.compress(raw.as_py()) for raw in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "packed"])

    # a row that is there twice has its key twice
    return texts.mapInArrow(pack, "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))


def found_links(rows: DataFrame, members: DataFrame, meetings: DataFrame) -> DataFrame:
    """Staged: class, n_texts, n_docs, first (smallest linked class), by meeting."""
    # meetings come to the classes before the texts do, so that shingles are shuffled once, to their meetings
    listed = meetings.groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("m"))
    some = F.explode(F.expr(f"transform(sequence(0, int((size(m) - 1) div {MEETINGS})), i -> slice(m, i * {MEETINGS} + 1, {MEETINGS}))"))
    packed = members.join(listed.select("block", some.alias("meets")), "block").join(packed_texts(rows, members), "key", "left").select("class", "copies", "block", "meets", "packed")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            if batch.column(4).null_count:
                raise RuntimeError("rows are not the same when they are read again")
            texts = pa.array([codec.decompress(x.as_py()).decode() for x in batch.column(4)], pa.large_string())
            made = [np.concatenate([signature(s).view(np.uint64), s]).tobytes() for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(made, pa.binary())], ["class", "copies", "block", "meets", "shingles"])

    shingled = packed.mapInArrow(unpack, "class long, copies long, block long, meets array<struct<a: long, b: long>>, shingles binary")
    each = shingled.select(F.explode("meets").alias("m"), "class", "copies", "block", "shingles")
    dealt = each.select("m.a", "m.b", "class", "copies", "block", "shingles").repartition("a", "b").sortWithinPartitions("a", "b", "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def done():
            out = compared(members, key[0] != key[1]) if len(members) > 1 else {}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*out.values(), strict=True))], ["class", "n_texts", "n_docs", "first"])

        for batch in batches:
            for a, b, own, copies, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != key:
                    if key is not None:
                        yield from done()
                    key, members = (a, b), []
                members.append((own, copies, block == a, np.frombuffer(raw, np.uint64)))
        if key is not None:
            yield from done()

    return staged(dealt.mapInArrow(compare, "class long, n_texts long, n_docs long, first long"), "links")


def linked_rows(rows: DataFrame) -> DataFrame:
    """Staged: (at, doc_id, class_id, class_at, set_first, n_links, n_texts, ...) of rows (at, doc_id, text, ...).

    class_at is the row with the smallest identifier of the linked group.
    """
    with scratch(rows.sparkSession):
        return staged(_linked_rows(rows), "linked", last=True)


def _linked_rows(rows: DataFrame) -> DataFrame:
    texts = keyed(rows)
    sketches = sketched(texts)
    sets = classes(sketches)
    linked = found_links(texts, *blocks(sets))
    degree = linked.groupBy("class").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    joined = components(linked.select(F.col("class").alias("u"), F.col("first").alias("v"))).withColumnsRenamed({"node": "class"})
    groups = staged(joined.join(sets.select("class", "first_id"), "class"), "groups")
    stands = groups.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "class")).alias("m")).select("component", F.col("m.first_id").alias("class_id"), F.col("m.class").alias("class_at"))
    by_class = groups.join(stands, "component").select("class", "class_id", "class_at")
    by_set = sets.select("set_id", "class", "first_id", "copies").join(degree, "class", "left").join(by_class, "class", "left")
    of_row = sketches.select("at", "doc_id", "set_id", *rows.columns[3:]).join(by_set, "set_id", "left")
    some, grouped = F.col("set_id").isNotNull(), F.col("class_at").isNotNull()
    return of_row.select(
        "at",
        "doc_id",
        F.when(grouped, F.col("class_id")).when(some, F.col("first_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_at", "class", "at").alias("class_at"),
        F.when(some, F.col("first_id")).otherwise(F.col("doc_id")).alias("set_first"),
        (F.coalesce("n_docs", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        *rows.columns[3:],
    )


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, set_first, n_links, n_texts) for each row of ``docs``.

    class_id is the smallest identifier of the linked group, set_first that of the
    documents with the same shingle set; n_links counts the other documents that
    are linked to this one, copies included, n_texts the different sets among them.
    """
    rows = sources(docs, "doc_id").select(F.monotonically_increasing_id().alias("at"), "doc_id", "text")
    return linked_rows(rows).drop("at", "class_at")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, of the smallest identifier, of each linked group."""
    path, row = fresh(docs, "path"), fresh(docs, "row")
    rows = located(docs, ["*"], path, row)
    texts = rows.select(F.monotonically_increasing_id().alias("at"), "doc_id", text_of().alias("text"), F.xxhash64(path).alias("file"), F.col(row).alias("row"))
    gone = linked_rows(texts).where("class_at <> at").select(F.col("file").alias(f"{path}_gone"), F.col("row").alias(f"{row}_gone"))
    return rows.join(gone, (F.xxhash64(path) == F.col(f"{path}_gone")) & (F.col(row) == F.col(f"{row}_gone")), "left_anti").drop(path, row)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir))
