"""Where a session's stores can lie."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import TableError


def scratch_root(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share;
    a temporary one where the session has none (local runs, tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise TableError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(shared or f'file://{tempfile.mkdtemp(prefix="tallgrass-")}').rstrip('/')}/store-{uuid.uuid4().hex}"
