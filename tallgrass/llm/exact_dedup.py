"""Exact deduplication with disk-backed streaming state (operator 9).

1. Each row's SHA-256 digest, identifier and content locator (file and row in it) go
   to a staged log.  Tables that are not read from files are staged first, so a
   locator is stable and can be read again.
2. A streaming query reads the log, a bounded number of files at a time, and
   keeps in RocksDB, for each digest and without expiry, the identifier and
   locator of the row that stays and the number of rows so far.  Rows are
   combined before the shuffle, so a text that a third of all rows share
   reaches its state as one row for each task.
3. Hits, digests seen more than once, are checked on full bytes: the smallest and the
   largest text of each have to be equal.  Should texts differ, the rows of that digest
   are grouped by the text itself.  Only texts of hits are shuffled: others are left
   out by a bitmap over the hits' digests (:func:`common.likely`), before the shuffle.

With a ``state`` folder the log, the state and the stream's progress stay there, and
further tables are compared with all that arrived before.  Texts of earlier arrivals
are then read from the files that the locators of hits name.

Rows: null text counts as empty, so null and empty texts are equal.  Of equal
texts the row with the largest identifier stays; of rows that also share the
identifier one stays, by locator.  A null identifier is the smallest.  An empty
table gives an empty result.  Other columns of the input are not read, whatever their
names; ``drop_copies`` returns them unchanged.  A very long text is one value like any
other; it is hashed where it is read and compared in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, likely, located, scratch, staged, staging_path, text_of

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_BATCH = 100_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def first_seen(log: DataFrame, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, group_size): the state after the whole log."""
    spark = log.sparkSession
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # state stays in the shared folder alone between batches: executors' disks hold one store for each running task
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    out = f"{folder}/state"
    arriving = session.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/log")
    state = arriving.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(out)

    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    # identifiers and counts only grow, so a batch written twice changes nothing
    latest = spark.read.schema(state.schema).parquet(out).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))
    return latest.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"), "group_size")


def exact_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """(file, row, doc_id, keep_id, group_size, kept, text_sha256) for each row of (doc_id, text, path, row); staged."""
    with scratch(docs.sparkSession):
        return staged(_exact_rows(docs, digest, files_per_batch, state), "copies", last=True)


def _exact_rows(docs: DataFrame, digest: Callable[[Column], Column], files_per_batch: int, state: str | None) -> DataFrame:
    spark = docs.sparkSession
    folder, arrival = (state or staging_path(spark, "digests")).rstrip("/"), uuid.uuid4().hex
    text = F.col("text")
    entry = docs.select(F.lit(arrival).alias("arrival"), "doc_id", "path", F.xxhash64("path").alias("file"), "row", digest(text).alias("digest"), sha256(text).alias("sha256"))
    entry.drop("path").write.mode("append").parquet(f"{folder}/log")
    docs.select(F.lit(arrival).alias("arrival"), "path", F.xxhash64("path").alias("file")).distinct().write.mode("append").parquet(f"{folder}/files")
    log = spark.read.schema(entry.drop("path").schema).parquet(f"{folder}/log")
    own = log.where(F.col("arrival") == arrival)
    columns = ["file", "row", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if own.isEmpty():
        return own.select("file", "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))
    seen = staged(first_seen(log, folder, files_per_batch), "digest-state")
    hits = seen.where("group_size > 1").select("digest")
    texts = docs.select("doc_id", "text", "path", "row")
    if state:
        hits = staged(hits.join(own.select("digest"), "digest", "left_semi"), "hits")
        files = spark.read.parquet(f"{folder}/files").where(F.col("arrival") != arrival)
        before = log.where(F.col("arrival") != arrival).join(hits, "digest", "left_semi").select("file").distinct()
        paths = [r["path"] for r in files.join(before, "file").select("path").distinct().collect()]  # names of files
        if paths:
            texts = texts.unionByName(located(spark.read.parquet(*map(unquote, paths)), ["doc_id", text_of().alias("text")]))
    texts = likely(texts.withColumn("digest", digest(text)), ["digest"], hits, "hit").where("hit").drop("hit")
    by_bytes = texts.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    differing = staged(by_bytes.where(F.col("least") != F.col("most")).select("digest").join(hits, "digest", "left_semi"), "differing")

    def result(members: DataFrame) -> DataFrame:
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        return members.withColumns({"kept": kept, "text_sha256": F.lower(F.hex("sha256"))}).select(*columns)

    if differing.isEmpty():
        return result(own.join(seen, "digest"))
    alike = result(own.join(seen, "digest").join(differing, "digest", "left_anti"))
    # texts themselves are the key among the few rows whose digests met
    clashing = staged(texts.join(differing, "digest", "left_semi").select("doc_id", "text", F.xxhash64("path").alias("file"), "row", sha256(text).alias("sha256")), "clashing")
    groups = clashing.groupBy("text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")).select("text", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"), "group_size")
    here = own.select("file", "row").withColumn("here", F.lit(True))
    return alike.unionByName(result(clashing.join(groups, "text").join(here, ["file", "row"], "left_semi")))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row.

    ``state``: a folder that keeps what arrived, for later calls.  Rows of earlier
    calls are counted, and can be the ones that stay; their results are not told again.
    """
    rows = located(docs, ["doc_id", text_of().alias("text")])
    return exact_rows(rows, digest, files_per_batch, state).drop("file", "row")


def drop_copies(docs: DataFrame, state: str | None = None) -> DataFrame:
    """``docs`` without the rows whose text another, kept row has."""
    path, row = fresh(docs, "path"), fresh(docs, "row")
    rows = located(docs, ["*"], path, row)
    found = exact_rows(rows.select("doc_id", text_of().alias("text"), F.col(path).alias("path"), F.col(row).alias("row")), state=state)
    gone = found.where(~F.col("kept")).select(F.col("file").alias(f"{path}_gone"), F.col("row").alias(f"{row}_gone"))
    return rows.join(gone, (F.xxhash64(path) == F.col(f"{path}_gone")) & (F.col(row) == F.col(f"{row}_gone")), "left_anti").drop(path, row)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP9_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (t)
"""
