"""Quality by importance resampling (operator 5).

Two hashed n-gram models, p of the target text and q of the raw text, are
multinomials over BUCKETS hash buckets of words and word pairs.  A document's log
importance weight is the sum of log p - log q over its n-grams, each model without
the document's own counts: else a document of the target would speak for itself, and
any other one against itself.  The k documents with the largest weight plus Gumbel
noise stay, which draws k documents without replacement in proportion to their
importance.

q is counted over all documents.  p is counted over the documents that labels call
good, of at most FIT_ROWS labelled rows, those with the smallest hash of their
identifier.  k is the number of documents whose weight reaches the value that best
splits these labelled rows into good and bad.

Only counts of buckets and at most FIT_ROWS labels with their weights reach the
driver.  The k-th largest score is found digit by digit: four counts of 65536 cells.

Rows: null text counts as empty, has weight 0 and is judged like any other row;
repeated rows share weight and noise, and all rows that tie with the k-th stay;
null identifiers share one noise value; without labels of both kinds there is no target and
everything stays; an empty table gives an empty result.  Other columns are not
read; ``select_quality`` returns them unchanged, whatever their names.  A very long
text is hashed alone, with memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import release
from .common import documents, fresh, importable, sources, staged, text_of
from .ngrams import mix, ngram_hashes, slices, word_hashes

BUCKETS = 10_000
FIT_ROWS = 20_000
SEED = 17
#: A good document that goes costs as much as this many bad ones that stay.
GOOD_COST = 5


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buckets, text number): hashed words and word pairs."""
    for first, last, data, starts in slices(texts):
        words, text = word_hashes(data, starts, lower=True)
        pairs, pair_text = ngram_hashes(words, text, 2)
        yield first, last, (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([text, pair_text])


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    start = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    u = (mix(ids.astype(np.int64).view(np.uint64) + start) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def order_key(score: np.ndarray) -> np.ndarray:
    """Integers in the order of the scores."""
    raw = np.ascontiguousarray(score, np.float64).view(np.int64)
    return np.where(raw < 0, np.int64(-(2**63)) - raw - 1, raw)


@dataclass
class Model:
    """Counts of the buckets in target and raw texts, and the target's documents."""

    target: np.ndarray
    raw: np.ndarray
    good: np.ndarray
    split: float | None = None
    least_key: int = -(2**63)

    @property
    def fitted(self) -> bool:
        return len(self.good) > 0

    def weights(self, ids: np.ndarray, texts: pa.Array) -> np.ndarray:
        out, own_target = np.zeros(len(texts)), np.isin(ids, self.good)
        if not self.fitted:
            return out
        n_target, n_raw = self.target.sum(), self.raw.sum()
        for first, last, bucket, text in features(texts):
            code, count = np.unique(text * BUCKETS + bucket, return_counts=True)
            text, bucket = code // BUCKETS, code % BUCKETS
            size = np.bincount(text, count, minlength=last - first)
            mine = own_target[first:last]
            # one more of each bucket in q; p leans on q with the weight of one of each
            q = (self.raw[bucket] - count + 1) / (n_raw - size + BUCKETS)[text]
            p = (self.target[bucket] - count * mine[text] + BUCKETS * q) / (n_target - size * mine + BUCKETS)[text]
            out[first:last] = np.bincount(text, count * np.log(p / q), minlength=last - first)
        return out

    def scores(self, number: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        weight = self.weights(number, texts)
        return weight, weight + gumbel(number)


def identifiers(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def labelled(labels: DataFrame, rows: int = FIT_ROWS) -> dict[int, int]:
    """At most ``rows`` labelled identifiers and their quality."""
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    return {r["doc_id"]: int(r["quality"]) for r in some.collect()}


def fit(docs: DataFrame, known: dict[int, int]) -> Model:
    """The two bucket models; one pass over all texts."""
    rows = sources(docs, "doc_id")
    good = np.array(sorted(i for i, q in known.items() if q == 1), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            own = np.isin(identifiers(batch.column(0)), good)
            for first, last, bucket, text in features(batch.column(1)):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[own[first:last][text]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counted = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    counts = np.zeros((2, BUCKETS))
    for r in counted:
        counts[:, r["bucket"]] = r["target"], r["raw"]
    if len(good) == len(known):
        good = good[:0]
    return Model(counts[0], counts[1], good)


def best_split(weights: list[tuple[float, int]]) -> float | None:
    """The least weight that is called good, by GOOD_COST times the share of good
    labelled rows from it on plus the share of bad ones below; the lowest of equals.
    Of (weight, quality) pairs, of which there are at most as many as labels."""
    if not weights:
        return None
    weight, quality = (np.array(c) for c in zip(*sorted(weights), strict=True))
    good, bad = quality == 1, quality != 1
    if not good.any() or not bad.any():
        return None
    above = np.cumsum(good[::-1])[::-1] / good.sum()
    below = np.append(0, np.cumsum(bad)[:-1]) / bad.sum()
    first = np.append(True, weight[1:] != weight[:-1])  # rows of one weight are not parted
    value = np.where(first, GOOD_COST * above + below, -1.0)
    return float(weight[np.argmax(value)])


def scored(docs: DataFrame, model: Model, known: dict[int, int], name: str = "scores") -> DataFrame:
    """Staged: ``docs`` with the struct ``name``: log_weight, score, key, quality of labelled rows.

    Only identifiers and texts go to Python; other columns stay where they are.
    """
    importable(docs.sparkSession)

    def score(ids: pa.Array, texts: pa.Array) -> pa.Array:
        number = identifiers(ids)
        weight, total = model.scores(number, texts)
        quality = pa.array([known.get(i) for i in ids.to_pylist()], pa.int32())
        return pa.StructArray.from_arrays([pa.array(weight), pa.array(total), pa.array(order_key(total)), quality], ["log_weight", "score", "key", "quality"])

    udf = F.arrow_udf(score, "log_weight double, score double, key long, quality int")
    return staged(docs.withColumn(name, udf(F.col("doc_id").cast("long"), text_of())), "scores")


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of ``key``, 16 bits at a time."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        # as unsigned digits of the key with its sign bit turned
        digit = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), shift)
        own = keys if shift == 48 else keys.where(F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), shift + 16) == prefix)
        cells = {r["d"]: r["n"] for r in own.groupBy(digit.bitwiseAND(0xFFFF).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for d in sorted(cells, reverse=True):
            if left <= cells[d]:
                prefix = (prefix << 16) | d
                break
            left -= cells[d]
    return prefix - 2**63


def settle(model: Model, scores: DataFrame) -> None:
    """Sets the split and the least key that stays; ``scores`` as :func:`scored` names them."""
    labelled = scores.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("log_weight", "quality")).alias("r")).select("r.*")
    model.split = best_split([tuple(r) for r in labelled.collect()])  # at most a row for each label
    if model.fitted and model.split is not None:
        k = scores.where(F.col("log_weight") >= model.split).count()
        if k:
            model.least_key = kth_largest(scores, k)


def resample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Model, DataFrame]:
    """The fitted model with the least key that stays, and the staged scores."""
    known = labelled(labels, fit_rows)
    model = fit(docs, known)
    scores = scored(sources(docs, "doc_id"), model, known).select("doc_id", "scores.*")
    settle(model, scores)
    return model, scores


def select_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, unchanged.

    Texts are scored once: the rows are staged with their scores and filtered there.
    """
    known, name = labelled(labels, FIT_ROWS), fresh(docs, "scores")
    model = fit(docs, known)
    rows = scored(docs, model, known, name)
    settle(model, rows.select("doc_id", f"{name}.*"))
    return rows.where(F.col(f"{name}.key") >= model.least_key).drop(name)


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scores = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", "log_weight", F.col("score").alias("gumbel_score"), (F.col("key") >= model.least_key).alias("kept"))
