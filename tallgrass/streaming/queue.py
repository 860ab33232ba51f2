"""A bounded queue that is read as a whole, in memory or as a stream."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import TableError

#: A put fails when it would be this many.
LIMIT = 300


class QueueFull(TableError):
    pass


class Queue:
    """First in, first out; ``get_all`` takes everything."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self._items, self._lock = limit, deque(), threading.Lock()

    def put(self, item: Any) -> None:
        with self._lock:
            if len(self._items) + 1 >= self.limit:
                raise QueueFull("item count exceed limit")
            self._items.append(item)

    def get_all(self) -> list[Any]:
        with self._lock:
            out, self._items = list(self._items), deque()
        return out

    def drain(self, spark: SparkSession, schema: str | T.StructType) -> DataFrame:
        return spark.createDataFrame(self.get_all(), schema)

    def __len__(self) -> int:
        return len(self._items)


def stream(spark: SparkSession, path: str, schema: T.StructType, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """The same for items that arrive as files: every batch is all that has come, once."""
    return spark.readStream.schema(schema).json(path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
