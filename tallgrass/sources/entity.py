"""Entities: named sets of typed columns with an integer ``Id``."""

from __future__ import annotations

import dataclasses
import datetime as dt
import math
import typing
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError

MAX_VALUE = 1_048_576
MAX_NEW_ID = (2**31 - 1) // 2
TYPES: dict[str, T.DataType] = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "datetime": T.TimestampNTZType(), "string": T.StringType(), "binary": T.BinaryType()}
_PYTHON = {int: "int", float: "double", str: "string", bytes: "binary", dt.datetime: "datetime"}
_REJECTED = {"bool", "decimal", "float", "long", "Decimal"}
#: What a row shows for a column that did not exist when it was written.
DEFAULTS = {"int": 0, "long": 0, "double": 0.0, "datetime": "0001-01-01 00:00:00"}


@dataclass(frozen=True)
class Entity:
    """``columns``: name -> type name of TYPES; others are left out, as unknown types are."""

    name: str
    columns: dict[str, str]

    @staticmethod
    def of(source: Any, strict_types: bool = False) -> Entity:
        """From a dataclass, or (name, columns)."""
        if isinstance(source, Entity):
            return source.checked(strict_types)
        if dataclasses.is_dataclass(source):
            columns = {}
            hints = typing.get_type_hints(source)
            for f in dataclasses.fields(source):
                kind = next((a for a in typing.get_args(hints[f.name]) if a is not type(None)), hints[f.name]) if typing.get_args(hints[f.name]) and type(None) in typing.get_args(hints[f.name]) else hints[f.name]
                if kind is bool or getattr(kind, "__name__", "") == "Decimal":
                    raise TableError(f"{kind.__name__.lower()} type is not supported, use {'int' if kind is bool else 'double'} instead")
                if kind in _PYTHON:
                    columns[f.name] = _PYTHON[kind]
            return Entity(getattr(source, "__name__", type(source).__name__), columns).checked(strict_types)
        name, columns = source
        return Entity(name, dict(columns)).checked(strict_types)

    def checked(self, strict_types: bool) -> Entity:
        for name, kind in self.columns.items():
            if kind in _REJECTED - (set() if strict_types else {"long"}):
                raise TableError(f"{kind} type is not supported ({name}), use {'double' if kind in ('float', 'decimal', 'Decimal') else 'int'} instead")
            if kind not in TYPES:
                raise TableError(f"{kind} type is not supported ({name})")
        if self.columns.get("Id") not in ("int", "long"):
            raise TableError("type must have integer Id property")
        return self

    @property
    def schema(self) -> T.StructType:
        return struct(self.columns)


def struct(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, TYPES[k]) for n, k in columns.items()])


def check_cell(name: str, kind: str, value: Any) -> Any:
    """The value as it is stored; errors as in the contract."""
    if value is None:
        return None
    if isinstance(value, bool):
        raise TableError("bool type is not supported, use int instead")
    ok = {"int": int, "long": int, "double": (int, float), "datetime": dt.datetime, "string": str, "binary": (bytes, bytearray)}[kind]
    if not isinstance(value, ok):
        raise TableError(f"wrong data type for given column: {name} is {kind}")
    if kind == "int" and not -(2**31) <= value < 2**31:
        raise TableError(f"wrong data type for given column: {name} is a 32-bit int")
    if kind == "double":
        value = float(value)
        if not math.isfinite(value):
            raise TableError(f"double with value {value} is not supported")
    if kind == "datetime":
        value = value.replace(microsecond=value.microsecond // 1000 * 1000, tzinfo=None)
    if kind in ("string", "binary"):
        if len(value) > MAX_VALUE:
            raise TableError("value max size is 1Mb")
        value = (bytes(value) if kind == "binary" else value) or None
    return value


def stored(name: str, kind: str) -> Column:
    """The same rules for a DataFrame's column; bad rows fail the job."""
    c = F.col(f"`{name}`").cast(TYPES[kind])
    fail = lambda bad, message: F.when(bad, F.raise_error(F.lit(message)).cast(TYPES[kind])).otherwise(c)
    if kind == "double":
        c = fail(F.isnan(c) | (F.abs(c) == float("inf")), "double with value NaN or infinity is not supported")
    elif kind == "datetime":
        c = F.date_trunc("millisecond", c).cast(TYPES[kind])
    elif kind in ("string", "binary"):
        c = F.when(F.length(c) > 0, fail(F.length(c) > MAX_VALUE, "value max size is 1Mb"))
    return c.alias(name)
