"""What the training-data operators share: staged tables and text columns."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch, where the session keeps Spark's default of 10,000: texts
#: of some kilobytes then take a few megabytes in a Python worker.
BATCH_ROWS = 1000


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tallgrass-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session (tests) that has none gets a temporary one; a cluster must name it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{_own_folder()}"
    raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are staged inside are deleted at its end, but those staged as ``last``."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for name in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staging_path(spark: SparkSession, name: str, last: bool = False) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[:-1] if last else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return path


def staged(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Later steps read the files, so a lost executor costs no recomputation and
    the plan that made them is cut off.
    """
    spark = df.sparkSession
    path = staging_path(spark, name, last)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(docs: DataFrame, columns: list, path: str = "path", row: str = "row") -> DataFrame:
    """``columns`` of ``docs`` with the file of each row and its number there."""
    importable(docs.sparkSession)

    def place(rows: DataFrame) -> list[Column]:
        hidden = rows.metadataColumn("_metadata")  # also where a column has that name
        return [hidden["file_path"].alias(path), hidden["row_index"].alias(row)]

    try:
        return docs.select(*columns, *place(docs))
    except AnalysisException:  # not rows of files: these are
        rows = staged(docs.select(*columns), "rows", last=True)
        return rows.select("*", *place(rows))


#: Bits of a bitmap over keys; as words of 64 bits it has BITS / 64 rows at most, 4 MB.
BITS = 1 << 24


def likely(rows: DataFrame, of: list[str], keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false where the columns ``of`` are surely not in ``keys``.

    A bitmap of BITS bits over the hashes of the keys, broadcast.  With more keys than
    bits it only says true more often.
    """
    bit = F.pmod(F.xxhash64(*of), F.lit(BITS))
    word, flag = F.floor(bit / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = keys.groupBy(word.alias(f"{name}_word")).agg(F.bit_or(flag).alias(f"{name}_bits"))
    joined = rows.join(F.broadcast(words), word == F.col(f"{name}_word"), "left")
    return joined.withColumn(name, F.coalesce(F.col(f"{name}_bits").bitwiseAND(flag) != 0, F.lit(False))).drop(f"{name}_word", f"{name}_bits")


def importable(spark: SparkSession) -> None:
    """Python workers that start from now on find this package where the driver did,
    and get batches of BATCH_ROWS rows unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sources(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """Only the columns an operator needs, the text without nulls.

    Other columns are left behind here, so none can clash with the operator's
    own names.
    """
    importable(docs.sparkSession)
    return docs.select(*columns, text_of(text).alias(text))


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new to ``df``."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name
