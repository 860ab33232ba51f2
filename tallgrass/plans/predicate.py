"""Predicates of the query language and their lowering to Spark columns.

Field proxies build a small immutable tree.  Lowering decides what SQL leaves open
or does otherwise: equality knows null, strings compare without case, an empty
string is null, and a row written before a column existed matches nothing on it.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError
from ..functions.text import has_prefix, has_word, query_words

STEP = 1000
#: Longer value lists become a join.
MAX_INLINE = 10_000


@dataclass(frozen=True)
class Context:
    """How columns of a table are reached."""

    schema: dict[str, T.DataType]
    id_col: str
    search: dict[str, str] = field(default_factory=dict)
    #: rows that have no value for the column, or None if there are none
    gap: Callable[[str], Column | None] = lambda _: None

    def kind(self, name: str) -> T.DataType:
        if name not in self.schema:
            raise TableError(f"there is no column {name}")
        return self.schema[name]

    def present(self, name: str, condition: Column) -> Column:
        gap = self.gap(name)
        return condition if gap is None else condition & ~gap


class Node:
    """A predicate; combine with & and | only."""

    def __and__(self, other: Node) -> Node:
        return Junction("and", (self, _node(other)))

    def __or__(self, other: Node) -> Node:
        return Junction("or", (self, _node(other)))

    def __invert__(self):
        raise TableError("only & and | operators are supported in where")

    __xor__ = __rxor__ = lambda self, other: self.__invert__()

    def __bool__(self):
        raise TableError("use & and | between conditions, in parentheses")

    def lower(self, ctx: Context) -> Column:
        raise NotImplementedError


def _node(x: Any) -> Node:
    if not isinstance(x, Node):
        raise TableError("error in where: a condition must compare a column with a value")
    return x


@dataclass(frozen=True)
class Junction(Node):
    op: str
    parts: tuple[Node, ...]

    def lower(self, ctx: Context) -> Column:
        cols = [p.lower(ctx) for p in self.parts]
        return reduce((lambda a, b: a & b) if self.op == "and" else (lambda a, b: a | b), cols)


def check_value(value: Any) -> Any:
    if isinstance(value, (Field, Node, Column)) or callable(value):
        raise TableError("error in where: the right hand side must be a value")
    if isinstance(value, bool):
        raise TableError("bool type is not supported, use int instead")
    if isinstance(value, float) and not math.isfinite(value):
        raise TableError(f"double with value {value} is not supported")
    if value is not None and not isinstance(value, (int, float, str, bytes, bytearray, dt.date)):
        raise TableError(f"values of type {type(value).__name__} are not supported")
    return value


def _same_kind(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, (bytes, bytearray)):
        return isinstance(kind, T.BinaryType)
    if isinstance(value, dt.date):
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return isinstance(kind, T.NumericType)


def literal(kind: T.DataType, value: Any) -> Column:
    if not _same_kind(kind, value):
        raise TableError(f"wrong data type for given column: {kind.simpleString()} and {type(value).__name__}")
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    # by way of text: exact for every year and free of the driver's time zone
    return F.lit(value.isoformat(sep=" ")).cast(kind) if isinstance(value, dt.date) else F.lit(value)


def cell(kind: T.DataType, value: Any) -> Any:
    """``value`` as a cell of a column, for long value lists; ``literal``'s rules and
    errors.  A number that no cell of the column equals becomes null."""
    if value is None:
        return None
    literal(kind, value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(kind, T.NumericType):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
        return int(value) if value == int(value) and -(2 ** (bits - 1)) <= value < 2 ** (bits - 1) else None
    return value


@dataclass(frozen=True)
class Compare(Node):
    op: str
    column: str
    value: Any

    def lower(self, ctx: Context) -> Column:
        kind, c = ctx.kind(self.column), F.col(f"`{self.column}`")
        text = isinstance(kind, T.StringType)
        value = None if text and self.value == "" else self.value
        if self.op in ("==", "!="):
            if value is None:
                none = (c.isNull() | (c == "")) if text else c.isNull()
                empty = ~F.coalesce(c == "", F.lit(False)) if text else F.lit(True)
                return ctx.present(self.column, none if self.op == "==" else c.isNotNull() & empty)
            if isinstance(kind, T.BinaryType):
                raise TableError("binary columns compare with null only")
            v = literal(kind, value)
            if self.op == "==":
                return ctx.present(self.column, F.lower(c) == F.lower(v) if text else c == v)
            return ctx.present(self.column, ~F.lower(c).eqNullSafe(F.lower(v)) if text else ~c.eqNullSafe(v))
        if value is None:
            raise TableError("null has no order")
        if not isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise TableError(f"{self.op} is not supported on {kind.simpleString()} columns")
        v = literal(kind, value)
        return ctx.present(self.column, {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op])


@dataclass(frozen=True)
class Between(Node):
    column: str
    low: Any
    high: Any
    bounds: str = "[]"

    def lower(self, ctx: Context) -> Column:
        if self.bounds not in ("[]", "[)", "(]", "()"):
            raise TableError("bounds must be one of [] [) (] ()")
        if isinstance(ctx.kind(self.column), (T.StringType, T.BinaryType)):
            raise TableError("between needs a numeric or date column")
        low = Compare(">=" if self.bounds[0] == "[" else ">", self.column, self.low)
        high = Compare("<=" if self.bounds[1] == "]" else "<", self.column, self.high)
        return low.lower(ctx) & high.lower(ctx)


@dataclass(frozen=True)
class In(Node):
    column: str
    values: tuple

    def lower(self, ctx: Context) -> Column:
        kind, c = ctx.kind(self.column), F.col(f"`{self.column}`")
        text = isinstance(kind, T.StringType)
        values = [None if text and v == "" else v for v in self.values]
        some = [v for v in values if v is not None]
        found = F.lit(False)
        if some:
            found = (F.lower(c) if text else c).isin([F.lower(literal(kind, v)) if text else literal(kind, v) for v in dict.fromkeys(some)])
        if len(some) < len(values):
            found = F.coalesce(found, F.lit(False)) | Compare("==", self.column, None).lower(ctx)
        return ctx.present(self.column, found)


@dataclass(frozen=True, eq=False)
class InFrame(Node):
    """Membership in a one-column DataFrame; joined by the query."""

    column: str
    frame: Any


@dataclass(frozen=True)
class Search(Node):
    column: str
    query: str
    prefix: bool = False
    start_step: int | None = None
    steps: int | None = None

    def lower(self, ctx: Context) -> Column:
        if self.column not in ctx.search or not isinstance(ctx.kind(self.column), T.StringType):
            raise TableError("only string properties named ...Search or ...SearchS can be searched")
        if (self.start_step is None) != (self.steps is None):
            raise TableError("start_step and steps parameters must be used together")
        within = F.lit(True)
        if self.steps is not None:
            i = F.col(f"`{ctx.id_col}`")
            within = (i >= self.start_step * STEP) & (i < (self.start_step + self.steps) * STEP)
        if self.query == "":
            return within
        words = query_words(self.query)
        if not words:
            return F.lit(False)
        has = has_prefix if self.prefix else has_word
        c, kind = F.col(f"`{self.column}`"), ctx.search[self.column]
        return ctx.present(self.column, reduce(lambda a, b: a & b, [has(c, kind, w) for w in words]) & within)


class Field:
    """A column in ``where``."""

    def __init__(self, name: str):
        self.name = name

    def _compare(self, op: str, value: Any) -> Compare:
        return Compare(op, self.name, check_value(value))

    __eq__ = lambda self, v: self._compare("==", v)  # type: ignore[assignment]
    __ne__ = lambda self, v: self._compare("!=", v)  # type: ignore[assignment]
    __lt__ = lambda self, v: self._compare("<", v)
    __le__ = lambda self, v: self._compare("<=", v)
    __gt__ = lambda self, v: self._compare(">", v)
    __ge__ = lambda self, v: self._compare(">=", v)
    __hash__ = None  # type: ignore[assignment]

    def _no_expression(self, *_):
        raise TableError("error in where: expressions of columns are not supported")

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = _no_expression
    __mod__ = __rmod__ = __floordiv__ = __neg__ = __abs__ = __pow__ = __getitem__ = __bool__ = __invert__ = _no_expression


class Fields:
    """``f`` in ``where(lambda f: f.a > 1)``."""

    def __getattr__(self, name: str) -> Field:
        return Field(name)

    def __getitem__(self, name: str) -> Field:
        return Field(name)


def parse(condition: Callable[[Fields], Node] | Node) -> Node:
    return _node(condition if isinstance(condition, Node) else condition(Fields()))
