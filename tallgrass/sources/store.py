"""A store of typed tables in Parquet, with atomic changes over several tables.

A table's rows lie in buckets of BUCKET_IDS consecutive ids.  A change rewrites only
the buckets that hold rows it touches; the manifest then names the new files.  Readers
keep the files of the version they began with.

Every row carries the number of its shape, the set of columns it was written with.
A column outside a row's shape is a gap: it reads as the type's default and matches
no predicate, unlike a null that was written.
"""

from __future__ import annotations

import dataclasses
import json
import threading
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError
from ..operators.query import Query, search_kinds
from .entity import DEFAULTS, MAX_NEW_ID, TYPES, Entity, check_cell, stored, struct
from .manifest import Files, Manifest

BUCKET_IDS = 1 << 20
SHAPE, BUCKET, ORDINAL = "__shape", "__bucket", "__ordinal"


class Store:
    def __init__(self, spark: SparkSession, root: str, delete_indexes: bool = True, strict_types: bool = False, strict_indexes: bool = False, bucket_ids: int = BUCKET_IDS):
        self.spark, self.strict_types, self.strict_indexes = spark, strict_types, strict_indexes
        self.files = Files(spark, root if "://" in root else f"file://{root}")
        self.manifest = Manifest(self.files)
        self.manifest.data.setdefault("bucket_ids", bucket_ids)
        self.lock = threading.RLock()
        self._cached: dict[str, tuple[DataFrame, list[tuple[str, str]]]] = {}
        if delete_indexes and self.manifest.data["indexes"]:
            self._save({**self.manifest.copy(), "indexes": {}})

    def _save(self, data: dict[str, Any]) -> None:
        self.manifest.save(data)
        self._forget(data)

    def _forget(self, data: dict[str, Any]) -> None:
        """Drops the caches of tables whose files are not those of ``data``."""
        for name, (df, folders) in list(self._cached.items()):
            if folders != sorted(data["tables"].get(name, {"buckets": {}})["buckets"].items()) or not any(x.startswith(f"{name} ") for x in data["indexes"]):
                df.unpersist()
                del self._cached[name]

    def refresh(self) -> None:
        """Takes up what other handles on the folder have changed."""
        with self.lock:
            if self.manifest.refresh():
                self._forget(self.manifest.data)

    def table(self, entity: Any, transaction: Transaction | None = None) -> Table:
        return Table(self, Entity.of(entity, self.strict_types), transaction)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def tables(self) -> list[str]:
        return sorted(self.manifest.data["tables"])

    def table_definition(self, name: str) -> str | None:
        """The table as class source; null if there is none."""
        info = self.manifest.data["tables"].get(name)
        if info is None:
            return None
        shown = {"int": "int?", "long": "long?", "double": "double?", "datetime": "DateTime?", "string": "string", "binary": "byte[]"}
        rest = "".join(f"public {shown[k]} {c} {{ get; set; }} " for c, k in info["columns"].items() if c != "Id")
        return f"public class {name} {{ public int Id {{ get; set; }} {rest} }} "

    def existing_indexes(self) -> list[str]:
        return sorted(self.manifest.data["indexes"])

    def replicate(self, path: str) -> None:
        """A copy of the current version elsewhere."""
        target = path if "://" in path else f"file://{path}"
        files = Files(self.spark, target)
        if files.exists(target):
            raise TableError("replicate folder already exists")
        data = self.manifest.copy()
        files.make(target)
        for info in data["tables"].values():
            for folder in set(info["buckets"].values()):
                files.make(f"{target}/{folder}".rsplit("/", 1)[0])
                self.files.copy(f"{self.files.root}/{folder}", f"{target}/{folder}")
        files.replace(f"{target}/{Manifest.NAME}", json.dumps(data))

    def status(self) -> dict[str, Any]:
        """Whether the engine answers, and what it runs on."""
        alive = self.spark.range(1).count() == 1
        return {"is_up": alive, "version": self.spark.version, "store_version": self.manifest.data["version"]}

    def close(self) -> None:
        for df, _ in self._cached.values():
            df.unpersist()
        self._cached.clear()


class Transaction:
    """Changes of several tables that become visible together at ``commit``."""

    def __init__(self, store: Store):
        self.store, self.changes = store, []
        self._whole: set[tuple[str, int]] = set()
        self._fields: set[tuple[str, int, str]] = set()

    def _add(self, table: str, ids: Iterable[int], column: str | None, change) -> None:
        for i in ids:
            if column is None:
                if (table, i) in self._whole or any(t == table and j == i for t, j, _ in self._fields):
                    raise TableError("same entity cannot be modified twice in a transaction")
            elif (table, i) in self._whole:
                raise TableError("same entity cannot be modified twice in a transaction")
            elif (table, i, column) in self._fields:
                raise TableError("same entity's field cannot be updated twice")
        for i in ids:
            self._whole.add((table, i)) if column is None else self._fields.add((table, i, column))
        self.changes.append(change)

    def commit(self) -> None:
        if not self.changes:
            return
        with self.store.lock:
            self.store.refresh()
            data = self.store.manifest.copy()
            for change in self.changes:
                change(data)
            self.store._save(data)
        self.changes = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_) -> None:
        self.changes = []


class Table:
    """Handle of one table; queries start here, and changes go through it."""

    def __init__(self, store: Store, entity: Entity, transaction: Transaction | None = None):
        self.store, self.entity, self.tran = store, entity, transaction
        if entity.name in store.manifest.data["tables"]:
            self._merged(store.manifest.copy())  # a changed type is an error at once

    # -- reading ----------------------------------------------------------------

    def _merged(self, data: dict[str, Any]) -> dict[str, Any]:
        """The table's entry with this entity's columns and shape; made if new."""
        info = data["tables"].setdefault(self.entity.name, {"columns": {}, "shapes": [], "counter": 0, "buckets": {}})
        for name, kind in self.entity.columns.items():
            if info["columns"].setdefault(name, kind) != kind:
                raise TableError(f"Column type cannot be changed: {name} is {info['columns'][name]}")
        self._shape(info, self.entity.columns)
        return info

    @staticmethod
    def _shape(info: dict[str, Any], columns: Iterable[str]) -> int:
        names = sorted(columns)
        if names not in info["shapes"]:
            info["shapes"].append(names)
        return info["shapes"].index(names)

    def _rows(self, info: dict[str, Any], folders: Sequence[str] | None = None) -> DataFrame:
        spark = self.store.spark
        schema = T.StructType([*struct(info["columns"]).fields, T.StructField(SHAPE, T.IntegerType())])
        folders = sorted(set(info["buckets"].values())) if folders is None else list(folders)
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.store.files.root}/{f}" for f in folders))

    def query(self) -> Query:
        self.store.refresh()
        data = self.store.manifest.copy()
        info = self._merged(data)
        name, shapes = self.entity.name, info["shapes"]

        def gap(column: str) -> Column | None:
            missing = [i for i, s in enumerate(shapes) if column not in s]
            return F.col(SHAPE).isin(missing) if missing else None

        def default(column: str) -> Column | None:
            kind = info["columns"][column]
            return F.lit(DEFAULTS[kind]).cast(TYPES[kind]) if kind in DEFAULTS else None

        df = self._rows(info)
        if any(x.startswith(f"{name} ") for x in data["indexes"]):
            if name not in self.store._cached:
                self.store._cached[name] = df.cache(), sorted(info["buckets"].items())
            df = self.store._cached[name][0]
        indexed = {tuple(x.split(" ")[1:]) for x in data["indexes"] if x.startswith(f"{name} ") and x.count(" ") == 2}
        return Query(df, "Id", tuple(self.entity.columns), search_kinds(self.entity.schema), gap=gap, default=default, max_id=lambda: info["counter"], group_indexes=lambda: indexed)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.query(), name)

    def count(self) -> int:
        return self.query().count()

    # -- changing ---------------------------------------------------------------

    def _change(self, ids: Iterable[int], column: str | None, change) -> None:
        if self.tran is not None:
            self.tran._add(self.entity.name, list(ids), column, change)
            return
        with self.store.lock:
            self.store.refresh()
            data = self.store.manifest.copy()
            change(data)
            self.store._save(data)

    def _staged(self, df: DataFrame) -> DataFrame:
        """A caller's rows, evaluated once: a change reads them several times."""
        path = f"{self.store.files.root}/{self.entity.name}/delta-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def _rewrite(self, data: dict[str, Any], info: dict[str, Any], delta: DataFrame, make) -> None:
        """Replace the buckets of ``delta``'s ids by ``make(their rows)``."""
        size = data["bucket_ids"]
        bucket = F.floor(F.col("Id") / size).cast("long")
        touched = {str(r[0]) for r in delta.select(bucket.alias("b")).distinct().collect()}  # bucket numbers only
        if not touched:
            return
        # a folder may hold several buckets of one write
        held = {b: f for b, f in info["buckets"].items() if b in touched}
        base = self._rows(info, [f"{f}" for f in held.values()]) if held else self._rows(info, [])
        folder = f"{self.entity.name}/{uuid.uuid4().hex}"
        # a bucket of 2^20 ids is one task's work, and one file
        make(base).withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.files.root}/{folder}")
        for b in touched:
            part = f"{folder}/{BUCKET}={b}"
            if self.store.files.exists(f"{self.store.files.root}/{part}"):
                info["buckets"][b] = part
            else:
                info["buckets"].pop(b, None)

    def _upsert(self, data: dict[str, Any], info: dict[str, Any], delta: DataFrame, shape: int) -> None:
        """``delta``: this entity's columns; wins over stored rows, whose other columns stay."""
        own = list(self.entity.columns)
        before = info["shapes"].copy()
        union = {i: self._shape(info, {*s, *own}) for i, s in enumerate(before)}

        def make(base: DataFrame) -> DataFrame:
            new = delta.select(*(F.col(f"`{c}`").alias(f"__new_{c}") for c in own))
            both = base.join(new, F.col("Id") == F.col("__new_Id"), "full_outer")
            fresh, old = F.col("__new_Id").isNotNull(), F.col("Id").isNotNull()
            shapes = F.lit(shape)
            for i, u in union.items():
                shapes = F.when(old & (F.col(SHAPE) == i), F.lit(u)).otherwise(shapes)
            columns = [(F.when(fresh, F.col(f"__new_{c}")).otherwise(F.col(f"`{c}`")) if c in own else F.col(f"`{c}`")).alias(c) for c in info["columns"]]
            return both.select(*columns, F.when(fresh, shapes).otherwise(F.col(SHAPE)).cast("int").alias(SHAPE))

        self._rewrite(data, info, delta, make)

    def _check_indexed(self, data: dict[str, Any], rows: list[dict[str, Any]] | None) -> None:
        for x in data["indexes"]:
            parts = x.split(" ")
            if parts[0] != self.entity.name:
                continue
            for c in parts[1:]:
                if c not in self.entity.columns:
                    raise TableError(f"{c} is indexed in memory and missing in the saved type")
                if rows is not None and any(r.get(c) is None for r in rows):
                    raise TableError("in-memory indexes do not support null values")

    def save(self, item: Any) -> int:
        """Upsert one row; its id, a new one for 0, also written back to the item."""
        return self.save_batch([item])[0]

    def save_batch(self, items: Iterable[Any] | DataFrame | None) -> list[int]:
        """Upsert rows; the ids in order.  Of rows with one id the first wins.

        A DataFrame is upserted without passing the driver and has to bring its ids.
        """
        if isinstance(items, DataFrame):
            return self._save_frame(items)
        items = list(items or [])
        if not items:
            return []
        rows = []
        for item in items:
            get = item.get if isinstance(item, dict) else lambda c, item=item: getattr(item, c, None)
            row = {c: check_cell(c, k, get(c)) for c, k in self.entity.columns.items()}
            row["Id"] = row["Id"] or 0
            if row["Id"] < 0:
                raise TableError("Id must not be negative")
            rows.append(row)
        with self.store.lock:
            self.store.refresh()
            info = self.store.manifest.data["tables"].get(self.entity.name)
            self._check_indexed(self.store.manifest.data, rows)
            counter = max(info["counter"] if info else 0, getattr(self.tran, "_counters", {}).get(self.entity.name, 0))
            for row, item in zip(rows, items, strict=True):
                row["Id"] = row["Id"] or counter + 1
                if row["Id"] > counter and row["Id"] > MAX_NEW_ID:
                    raise TableError(f"max Id value of new item is {MAX_NEW_ID}")
                counter = max(counter, row["Id"])
                item.__setitem__("Id", row["Id"]) if isinstance(item, dict) else setattr(item, "Id", row["Id"])
            if self.tran is not None:
                self.tran._counters = {**getattr(self.tran, "_counters", {}), self.entity.name: counter}
            first: dict[int, dict[str, Any]] = {}
            for row in rows:
                first.setdefault(row["Id"], row)

            def change(data: dict[str, Any]) -> None:
                info = self._merged(data)
                info["counter"] = max(info["counter"], counter)
                delta = self.store.spark.createDataFrame([tuple(r[c] for c in self.entity.columns) for r in first.values()], self.entity.schema)
                self._upsert(data, info, delta, self._shape(info, self.entity.columns))

            self._change(first, None, change)
        return [r["Id"] for r in rows]

    def _save_frame(self, df: DataFrame) -> list[int]:
        if self.tran is not None:
            raise TableError("a DataFrame can't be saved in a transaction")
        missing = set(self.entity.columns) - set(df.columns)
        if missing:
            raise TableError(f"the DataFrame has no column {sorted(missing)[0]}")
        checked = self._staged(df.select(*(stored(c, k) for c, k in self.entity.columns.items()), F.monotonically_increasing_id().alias(ORDINAL)))
        rest = [c for c in self.entity.columns if c != "Id"]
        delta = checked.groupBy("Id").agg(F.min_by(F.struct(*rest), ORDINAL).alias("r")).select("Id", "r.*") if rest else checked.select("Id").distinct()
        bounds = checked.agg(F.min("Id"), F.max("Id"), F.count_if(F.col("Id").isNull())).first()
        if bounds[0] is None and not bounds[2]:
            return []
        if bounds[2] or bounds[0] < 1:
            raise TableError("rows of a DataFrame need positive ids")
        self._check_indexed(self.store.manifest.data, None)

        def change(data: dict[str, Any]) -> None:
            info = self._merged(data)
            if self.store.strict_types and bounds[1] > max(info["counter"], MAX_NEW_ID):
                raise TableError(f"max Id value of new item is {MAX_NEW_ID}")
            info["counter"] = max(info["counter"], bounds[1])
            self._upsert(data, info, delta, self._shape(info, self.entity.columns))

        self._change([], None, change)
        return []

    def update(self, column: str, values: int | dict[int, Any] | DataFrame, value: Any = None) -> None:
        """Set ``column`` of the rows with these ids; unknown ids are left out.

        One id and its value, a dict, or a DataFrame (Id, value)."""
        kind = self.entity.columns.get(column)
        if kind is None or column == "Id":
            raise TableError(f"{column} can't be updated")
        frame = isinstance(values, DataFrame)
        if not frame:
            pairs = values if isinstance(values, dict) else {values: value}
            pairs = {i: check_cell(column, kind, v) for i, v in pairs.items()}
            if not pairs:
                return
            if any(v is None for v in pairs.values()) and any(column in x.split(" ")[1:] for x in self.store.manifest.data["indexes"] if x.startswith(f"{self.entity.name} ")):
                raise TableError("in-memory indexes do not support null values")

        def change(data: dict[str, Any]) -> None:
            info = self._merged(data)
            schema = T.StructType([T.StructField("Id", TYPES[self.entity.columns["Id"]]), T.StructField(column, TYPES[kind])])
            delta = values.toDF("Id", column).select("Id", stored(column, kind), F.monotonically_increasing_id().alias(ORDINAL)) if frame else self.store.spark.createDataFrame(list(pairs.items()), schema)
            if frame:
                delta = self._staged(delta).groupBy("Id").agg(F.min_by(F.struct(column), ORDINAL).alias("r")).select("Id", "r.*")
            before = info["shapes"].copy()
            union = {i: self._shape(info, {*s, column}) for i, s in enumerate(before)}

            def make(base: DataFrame) -> DataFrame:
                new = delta.select(F.col("Id").alias("__id"), F.col(f"`{column}`").alias("__value"))
                both = base.join(new, F.col("Id") == F.col("__id"), "left")
                hit, shape = F.col("__id").isNotNull(), F.col(SHAPE)
                for i, u in union.items():
                    if i != u:
                        shape = F.when(F.col(SHAPE) == i, F.lit(u)).otherwise(shape)
                columns = [F.when(hit, F.col("__value")).otherwise(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in info["columns"]]
                return both.select(*columns, F.when(hit, shape).otherwise(F.col(SHAPE)).cast("int").alias(SHAPE))

            known = self.store.spark.createDataFrame([(b,) for b in info["buckets"]], "b string")
            inside = delta.withColumn("b", F.floor(F.col("Id") / data["bucket_ids"]).cast("long").cast("string")).join(known, "b", "left_semi")
            self._rewrite(data, info, inside, make)

        self._change([] if frame else pairs, column, change)

    def delete(self, ids: int | Iterable[int] | DataFrame) -> None:
        """Delete rows by id; unknown ids are left out."""
        frame = isinstance(ids, DataFrame)
        some = [] if frame else list({ids} if isinstance(ids, int) else set(ids))
        if not frame and not some:
            return

        def change(data: dict[str, Any]) -> None:
            info = self._merged(data)
            delta = self._staged(ids.toDF("Id")) if frame else self.store.spark.createDataFrame([(i,) for i in some], "Id long")
            self._rewrite(data, info, delta, lambda base: base.join(delta.select("Id"), "Id", "left_anti").select(*info["columns"], SHAPE))

        self._change(some, None, change)

    def _batches(self, size: int) -> None:
        if self.tran is not None:
            raise TableError("non-atomic operations can't be used in a transaction")
        if size <= 0:
            raise TableError("batchSize must be positive number")

    def save_non_atomically(self, items: Iterable[Any], batch_size: int = 5000) -> list[int]:
        self._batches(batch_size)
        return self.save_batch(items)

    def update_non_atomically(self, column: str, values: dict[int, Any], batch_size: int = 5000) -> None:
        self._batches(batch_size)
        self.update(column, values)

    def delete_non_atomically(self, ids: Iterable[int], batch_size: int = 5000) -> None:
        self._batches(batch_size)
        self.delete(ids)

    def _increment(self, columns: list[str], by: list[int], new_item: Any, query: Query | None, only_if: int | None) -> int | None:
        if self.tran is not None:
            raise TableError("transactions are not supported with AtomicIncrement")
        if new_item is None:
            raise TableError("new_item_if_doesnt_exist can't be null")
        for c in columns:
            if c == "Id":
                raise TableError("can't modify Id property")
            if self.entity.columns.get(c) != "int":
                raise TableError("property to increment must be of type int")
        with self.store.lock:
            clauses = query.clauses if query is not None else ()
            now = self.query()
            found = dataclasses.replace(now, clauses=clauses).select("Id", *columns).limit(2).collect()
            if len(found) > 1:
                raise TableError("more than one item identified")
            if not found:
                self.save(new_item)
                return None
            row, old = found[0], found[0][columns[0]]
            if only_if is None or old == only_if:
                wrap = lambda x: (x + 2**31) % 2**32 - 2**31
                with self.store.transaction() as t:
                    table = Table(self.store, self.entity, t)
                    for c, v in zip(columns, by, strict=True):
                        table.update(c, row["Id"], wrap((row[c] or 0) + v))
                    t.commit()
            return old

    def atomic_increment(self, column: str, by: int, new_item: Any, query: Query | None = None, only_if_old_equal: int | None = None) -> int | None:
        """Add to the one row that ``query`` finds, in 32 bits; its old value, or null
        if ``new_item`` was saved because there was none."""
        return self._increment([column], [by], new_item, query, only_if_old_equal)

    def atomic_increment_2(self, column1: str, column2: str, by1: int, by2: int, new_item: Any, query: Query | None = None) -> None:
        self._increment([column1, column2], [by1, by2], new_item, query, None)

    # -- memory indexes ---------------------------------------------------------

    def _index(self, columns: list[str]) -> None:
        for c in columns:
            if self.entity.columns.get(c) in (None, "string", "binary"):
                raise TableError(f"{c}: type is not supported as memory index")
        with self.store.lock:
            data = self.store.manifest.copy()
            info = self._merged(data)
            rows, q = self._rows(info), self.query()
            for c in columns:
                gap = q.gap(c)
                checks = rows.agg(F.count_if(F.col(f"`{c}`").isNull() & ~(gap if gap is not None else F.lit(False))).alias("nulls"), F.count_if(gap if gap is not None else F.lit(False)).alias("gaps")).first()
                if checks["gaps"]:
                    raise TableError(f"{c} has gaps in data")
                if checks["nulls"]:
                    raise TableError("in-memory indexes do not support null values")
            key = " ".join([self.entity.name, *columns])
            for k in {key, f"{self.entity.name} Id"}:
                data["indexes"][k] = data["indexes"].get(k, 0) + 1
            self.store._save(data)

    def _unindex(self, columns: list[str]) -> None:
        with self.store.lock:
            data = self.store.manifest.copy()
            for k in {" ".join([self.entity.name, *columns]), f"{self.entity.name} Id"}:
                if k in data["indexes"]:
                    data["indexes"][k] -= 1
                    if data["indexes"][k] <= 0:
                        del data["indexes"][k]
            self.store._save(data)

    def create_property_index(self, column: str) -> None:
        """Keep the table in memory for queries on ``column``."""
        self._index([column])

    def create_group_index(self, group: str, value: str) -> None:
        if self.entity.columns.get(group) not in ("int", "long"):
            raise TableError(f"{group}: type is not supported as group by column")
        self._index([group, value])

    def remove_property_index(self, column: str) -> None:
        self._unindex([column])

    def remove_group_index(self, group: str, value: str) -> None:
        self._unindex([group, value])
