"""Sharded tables: rows are identified by (Sid, Id), and Spark gathers all shards.

``Sid`` is a column of one table that is stored with its rows; ids are unique over
all shards, so single-table changes apply to the pair as well.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import TableError
from ..operators.query import Query
from .entity import TYPES, Entity, check_cell
from .store import Store, Table


class ShardedTable:
    def __init__(self, store: Store, entity: Any, shards: Iterable[int]):
        self.entity, self.shards = Entity.of(entity), list(shards)
        if self.entity.columns.get("Sid") != "int":
            raise TableError("type must have integer Id and Sid properties")
        if not self.shards:
            raise TableError("there are no shards")
        self.table: Table = store.table(self.entity)

    def save(self, item: dict[str, Any]) -> tuple[int, int]:
        if bool(item.get("Id")) != bool(item.get("Sid")):
            raise TableError("Id and Sid must both be equal to zero or both be set")
        if not item.get("Sid"):
            item["Sid"] = random.choice(self.shards)
        elif item["Sid"] not in self.shards:
            raise TableError(f"there is no shard {item['Sid']}")
        return item["Sid"], self.table.save(item)

    def save_batch(self, items: list[dict[str, Any]], batch_size: int = 5000) -> list[tuple[int, int]]:
        new = [not i.get("Id") for i in items]
        if any(new) and not all(new):
            raise TableError("Batch cannot contain both new and existing items")
        if any(bool(i.get("Id")) != bool(i.get("Sid")) for i in items):
            raise TableError("Id and Sid must both be equal to zero or both be set")
        strange = next((i["Sid"] for i in items if i.get("Sid") and i["Sid"] not in self.shards), None)
        if strange is not None:
            raise TableError(f"there is no shard {strange}")
        for k, item in enumerate(items):
            if all(new):
                item["Sid"] = self.shards[k % len(self.shards)]
        ids = self.table.save_non_atomically(items, batch_size)
        return [(i["Sid"], n) for i, n in zip(items, ids, strict=True)]

    def update(self, column: str, values: dict[tuple[int, int], Any]) -> None:
        kind = self.entity.columns.get(column)
        if kind is None or column in ("Id", "Sid"):
            raise TableError(f"{column} can't be updated")
        cells = [(s, i, check_cell(column, kind, v)) for (s, i), v in values.items()]
        if cells:
            self.table.update(column, self._known(cells, T.StructField("value", TYPES[kind])).select("Id", "value"))

    def delete(self, keys: Iterable[tuple[int, int]]) -> None:
        cells = [(s, i) for s, i in dict.fromkeys(keys)]
        if cells:
            self.table.delete(self._known(cells).select("Id"))

    def _known(self, cells: list[tuple], *more: T.StructField) -> DataFrame:
        """Of (Sid, Id, ...) those whose row is in that shard."""
        keys = T.StructType([T.StructField("Sid", T.IntegerType()), T.StructField("Id", TYPES[self.entity.columns["Id"]]), *more])
        return self.table.store.spark.createDataFrame(cells, keys).join(self.table.query().select("Sid", "Id"), ["Sid", "Id"], "left_semi")

    def on_shards(self, *shards: int) -> Query:
        """A query over some shards only."""
        if strange := set(shards) - set(self.shards):
            raise TableError(f"there is no shard {min(strange)}")
        return self.table.query().intersect("Sid", shards)

    # -- of the one table: indexes and catalogue -----------------------------------

    def create_property_index(self, column: str) -> None:
        self.table.create_property_index(column)

    def create_group_index(self, group: str, value: str) -> None:
        self.table.create_group_index(group, value)

    def remove_property_index(self, column: str) -> None:
        self.table.remove_property_index(column)

    def remove_group_index(self, group: str, value: str) -> None:
        self.table.remove_group_index(group, value)

    def tables(self) -> list[str]:
        return self.table.store.tables()

    def table_definition(self, name: str) -> str | None:
        return self.table.store.table_definition(name)

    def existing_indexes(self) -> list[str]:
        return self.table.store.existing_indexes()

    def __getattr__(self, name: str):
        if name.startswith("_") or name in ("table", "entity", "shards"):
            raise AttributeError(name)
        return getattr(self.table.query(), name)

    def count(self) -> int:
        return self.table.count()

    def per_shard(self, column: str):
        """Groups of each shard apart."""
        return self.table.query().group_by(column, per_shard="Sid")
