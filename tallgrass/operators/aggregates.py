"""Aggregates of grouped queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError

FUNCTIONS = ("count", "count_distinct", "sum", "min", "max", "avg")


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None

    def lower(self, schema: dict[str, T.DataType], compat_int32: bool) -> Column:
        if self.function not in FUNCTIONS:
            raise TableError(f"group aggregation function {self.function} is not supported")
        if self.function == "count":
            return F.count(F.lit(1))
        kind = schema.get(self.column or "")
        if kind is None:
            raise TableError(f"there is no column {self.column}")
        ordered = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and self.function in ("min", "max")
        if not isinstance(kind, T.NumericType) and not ordered:
            raise TableError(f"{kind.simpleString()} columns cannot be aggregated by {self.function}")
        c = F.col(f"`{self.column}`")
        if self.function == "sum":
            total = F.sum(c)
            if compat_int32 and isinstance(kind, T.IntegerType):
                return (F.pmod(total + 2**31, F.lit(2**32)) - 2**31).cast("int")
            return total
        return {"count_distinct": F.count_distinct, "min": F.min, "max": F.max, "avg": F.avg}[self.function](c)


def count() -> Aggregate:
    return Aggregate("count")


def count_distinct(column: str) -> Aggregate:
    return Aggregate("count_distinct", column)


def sum_(column: str) -> Aggregate:
    return Aggregate("sum", column)


def min_(column: str) -> Aggregate:
    return Aggregate("min", column)


def max_(column: str) -> Aggregate:
    return Aggregate("max", column)


def avg(column: str) -> Aggregate:
    return Aggregate("avg", column)
