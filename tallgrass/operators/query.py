"""Immutable fluent queries over one table, lowered to one lazy DataFrame."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError
from ..plans.predicate import MAX_INLINE, STEP, Between, Context, Field, In, InFrame, Node, Search, cell, check_value, parse
from .aggregates import Aggregate

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Steps that a time-limited search takes at a time.
TIMED_STEPS = 5


def search_kinds(schema: T.StructType) -> dict[str, str]:
    """Searchable columns by their name's ending."""
    out = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            low = f.name.lower()
            if low.endswith("searchs"):
                out[f.name] = "spaces"
            elif low.endswith("search"):
                out[f.name] = "words"
    return out


@dataclass
class Statistics:
    """``total``: matches before skip and take, counted when first asked for."""

    _matches: DataFrame
    searched_percentile: float = 100.0
    _total: int | None = None

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self._matches.count()
        return self._total


@dataclass(frozen=True)
class SelectedIds:
    ids: DataFrame
    _all: DataFrame

    @property
    def all_ids(self) -> bool:
        """Whether every row of the table matched."""
        return self.ids.count() == self._all.count()


@dataclass(frozen=True)
class Query:
    """A table and the conditions on it.

    ``frame`` holds the rows, ``id_col`` names the key.  Conditions are ANDed; ``or_``
    ties the one before it and the one after it, and binds tighter.
    """

    frame: DataFrame
    id_col: str
    columns: tuple[str, ...]
    search_columns: dict[str, str] = field(default_factory=dict)
    clauses: tuple[tuple[Node, bool], ...] = ()
    pending_or: bool = False
    gap: Callable[[str], Column | None] = lambda _: None
    default: Callable[[str], Column | None] = lambda _: None
    max_id: Callable[[], int] | None = None
    group_indexes: Callable[[], set[tuple[str, str]]] | None = None
    searched: float = 100.0

    @staticmethod
    def over(df: DataFrame, id_col: str = "Id", search: dict[str, str] | None = None) -> Query:
        """A query over any DataFrame with a key column."""
        if id_col not in df.columns or not isinstance(df.schema[id_col].dataType, INTEGERS):
            raise TableError(f"type must have integer {id_col} property")
        return Query(df, id_col, tuple(df.columns), search_kinds(df.schema) if search is None else search)

    @property
    def context(self) -> Context:
        return Context({f.name: f.dataType for f in self.frame.schema.fields if f.name in self.columns}, self.id_col, self.search_columns, self.gap)

    def _with(self, node: Node) -> Query:
        if not isinstance(node, InFrame):
            node.lower(self.context)  # errors show where the query is built
        clauses = self.clauses
        if self.pending_or:
            clauses = (*clauses[:-1], (clauses[-1][0], True))
        return dataclasses.replace(self, clauses=(*clauses, (node, False)), pending_or=False)

    # -- conditions -------------------------------------------------------------

    def where(self, condition) -> Query:
        return self._with(parse(condition))

    def between(self, column: str, low: Any, high: Any, bounds: str = "[]") -> Query:
        return self._with(Between(column, check_value(low), check_value(high), bounds))

    def intersect(self, column: str | None, values: Iterable[Any] | DataFrame | Query) -> Query:
        """Rows whose value is among ``values``: a list, a query's ids or a column."""
        column = column or self.id_col
        if isinstance(values, Query):
            values = values.get_ids().ids
        if isinstance(values, DataFrame):
            return self._with(InFrame(column, values))
        values = tuple(check_value(v) for v in values)
        if len(values) > MAX_INLINE:
            spark, kind = self.frame.sparkSession, self.context.kind(column)
            # null stays only where it was given
            cells = [(c,) for v in values if (c := cell(kind, v)) is not None or v is None]
            return self._with(InFrame(column, spark.createDataFrame(cells, T.StructType([T.StructField("v", kind)]))))
        return self._with(In(column, values))

    def search(self, column: str, query: str, start_step: int | None = None, steps: int | None = None) -> Query:
        return self._with(Search(column, query or "", False, start_step, steps))

    def search_partial(self, column: str, query: str) -> Query:
        return self._with(Search(column, query or "", True))

    def search_time_limited(self, column: str, query: str, max_ms: float) -> Query:
        """Search from the smallest ids on until the time is over.

        Steps are searched in runs that double in length while time is left; the
        result holds the steps reached, and its statistics their percentage.
        """
        self._with(Search(column, query or "", False, 0, 1))
        last, reached, run, end = self.last_step() + 1, 0, TIMED_STEPS, time.monotonic() + max_ms / 1000
        while reached < last:
            n = min(run, last - reached)
            self._with(Search(column, query or "", False, reached, n)).matches().select(F.count(F.lit(1))).collect()
            reached, run = reached + n, run * 2
            if time.monotonic() >= end:
                break
        found = self._with(Search(column, query or "", False, 0, max(reached, 1)))
        return dataclasses.replace(found, searched=100.0 * min(reached, last) / last)

    def or_(self) -> Query:
        if not self.clauses or self.pending_or:
            raise TableError("or_ needs a condition before it")
        return dataclasses.replace(self, pending_or=True)

    # -- lowering ---------------------------------------------------------------

    def matches(self) -> DataFrame:
        """The matching rows, with all stored columns."""
        if self.pending_or:
            raise TableError("or_ needs a condition after it")
        chains, tied = [], False
        for node, more in self.clauses:
            chains[-1].append(node) if tied else chains.append([node])
            tied = more
        df, ctx, found, flags = self.frame, self.context, [], []
        for n, chain in enumerate(chains):
            parts = []
            for k, node in enumerate(chain):
                if not isinstance(node, InFrame):
                    parts.append(node.lower(ctx))
                    continue
                kind, c = ctx.kind(node.column), F.col(f"`{node.column}`")
                text = isinstance(kind, T.StringType)
                v = F.col(f"`{node.frame.columns[0]}`")
                flag = f"__in_{n}_{k}"
                values = node.frame.select((F.lower(F.nullif(v, F.lit(""))) if text else v.cast(kind)).alias(flag)).distinct()
                # an index of which rows are in, without copies of them
                same = (F.lower(F.nullif(c, F.lit(""))) if text else c).eqNullSafe(F.col(flag))
                if len(chain) == 1:
                    df = df.join(values, same, "left_semi")
                    parts.append(ctx.present(node.column, F.lit(True)))
                else:
                    df = df.join(values.withColumn(f"{flag}_", F.lit(True)), same, "left")
                    flags += [flag, f"{flag}_"]
                    parts.append(ctx.present(node.column, F.col(f"{flag}_").isNotNull()))
            found.append(reduce(lambda a, b: a | b, parts))
        df = df.filter(reduce(lambda a, b: a & b, found)) if found else df
        return df.drop(*flags) if flags else df

    def shown(self, name: str) -> Column:
        """A column as projections show it: gaps read as the type's default."""
        self.context.kind(name)
        c, gap, default = F.col(f"`{name}`"), self.gap(name), self.default(name)
        return c if gap is None or default is None else F.when(gap, default).otherwise(c)

    def _projection(self, names, renames) -> list[Column]:
        pairs = []
        for out, x in [*((None, n) for n in names), *renames.items()]:
            x = x.name if isinstance(x, Field) else x
            if not isinstance(x, str):
                raise TableError("select must not have any expressions")
            pairs.append((out or x, x))
        if not pairs:
            raise TableError("select needs columns")
        if len({o for o, _ in pairs}) < len(pairs):
            raise TableError("select has a name twice")
        return [self.shown(x).alias(o) for o, x in pairs]

    # -- results ----------------------------------------------------------------

    def select(self, *names: str, **renames: str) -> DataFrame:
        projection = self._projection(names, renames)
        return self.matches().select(*projection)

    def select_entity(self) -> DataFrame:
        return self.select(*self.columns)

    def select_with_statistics(self, *names: str, **renames: str) -> tuple[DataFrame, Statistics]:
        return self.select(*(names or (() if renames else self.columns)), **renames), Statistics(self.matches(), self.searched)

    def select_non_atomically(self, *names: str, batch_size: int = 3000, **renames: str) -> Iterator[Row]:
        """Rows one by one, a partition at a time; still of one snapshot."""
        if batch_size <= 0:
            raise TableError("batchSize must be positive number")
        return self.select(*(names or (() if renames else self.columns)), **renames).toLocalIterator()

    select_entity_non_atomically = select_non_atomically

    def collect(self, *names: str, max_result_bytes: int = 300 * 2**20) -> list[Row]:
        """Rows on the driver; refuses results whose serialised size is beyond the limit."""
        df = self.select(*(names or self.columns))
        width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in df.schema.fields])
        size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
        if size > max_result_bytes:
            raise TableError(f"the query resulted in set larger than {max_result_bytes} bytes")
        return df.collect()

    def count(self) -> int:
        return self.matches().count()

    def get_ids(self) -> SelectedIds:
        one = F.col(f"`{self.id_col}`")
        return SelectedIds(self.matches().select(one), self.frame.select(one))

    def last_step(self) -> int:
        if self.max_id is not None:
            return self.max_id() // STEP
        return (self.frame.agg(F.max(f"`{self.id_col}`")).first()[0] or 0) // STEP

    def last_step_frame(self) -> DataFrame:
        """``last_step`` as a lazy one-row result."""
        return self.frame.agg(F.floor(F.coalesce(F.max(f"`{self.id_col}`"), F.lit(0)) / STEP).cast("long").alias("last_step"))

    def order_by(self, column: str, descending: bool = False) -> OrderedQuery:
        self.context.kind(column)
        return OrderedQuery(self, column, descending)

    def order_by_descending(self, column: str) -> OrderedQuery:
        return self.order_by(column, True)

    def group_by(self, column: str, per_shard: str | None = None, strict_indexes: bool = False, compat_int32: bool = False) -> GroupedQuery:
        if not isinstance(self.context.kind(column), INTEGERS):
            raise TableError(f"{column}: type is not supported as group by column")
        return GroupedQuery(self, column, per_shard, strict_indexes, compat_int32)


@dataclass(frozen=True)
class OrderedQuery:
    """One key; nulls first ascending and last descending; ties by id, in the same direction."""

    query: Query
    column: str
    descending: bool
    n_skip: int | None = None
    n_take: int | None = None

    def skip(self, n: int) -> OrderedQuery:
        return dataclasses.replace(self, n_skip=n)

    def take(self, n: int) -> OrderedQuery:
        return dataclasses.replace(self, n_take=n)

    def select(self, *names: str, **renames: str) -> DataFrame:
        q, c = self.query, self.query.shown(self.column)
        if isinstance(q.context.kind(self.column), T.StringType):
            c = F.lower(F.nullif(c, F.lit("")))
        i = F.col(f"`{q.id_col}`")
        projection = q._projection(names, renames)
        rows, order = q.matches(), (c.desc_nulls_last(), i.desc()) if self.descending else (c.asc_nulls_first(), i.asc())
        if self.n_skip and self.n_take is None:
            # what comes after the last row skipped, a top-k of keys: an offset alone puts the tail into one task
            key = F.struct(c.alias("k"), i.alias("i"))
            last = rows.orderBy(*order).offset(self.n_skip - 1).limit(1).select(key.alias("last")).scalar()
            return rows.filter(key < last if self.descending else key > last).orderBy(*order).select(*projection)
        df = rows.orderBy(*order)
        if self.n_skip:
            df = df.offset(self.n_skip)
        if self.n_take is not None:
            df = df.limit(self.n_take)
        return df.select(*projection)

    def select_entity(self) -> DataFrame:
        return self.select(*self.query.columns)

    def select_with_statistics(self, *names: str, **renames: str) -> tuple[DataFrame, Statistics]:
        return self.select(*(names or (() if renames else self.query.columns)), **renames), Statistics(self.query.matches(), self.query.searched)


@dataclass(frozen=True)
class GroupedQuery:
    query: Query
    column: str
    per_shard: str | None = None
    strict_indexes: bool = False
    compat_int32: bool = False

    def select(self, **outputs: Any) -> DataFrame:
        """``key="Key"`` for the group's value, aggregates for the rest."""
        q = self.query
        if not outputs:
            raise TableError("select needs columns")
        if self.strict_indexes:
            have = q.group_indexes() if q.group_indexes else set()
            if not any(g == self.column for g, _ in have):
                raise TableError(f"group index on property {self.column} does not exist")
            for a in outputs.values():
                if isinstance(a, Aggregate) and a.column and (self.column, a.column) not in have:
                    raise TableError(f"group index on property {a.column} does not exist")
        keys, aggregates = [], []
        for name, x in outputs.items():
            if x == "Key":
                keys.append(name)
            elif isinstance(x, Aggregate):
                aggregates.append(x.lower(q.context.schema, self.compat_int32).alias(name))
            else:
                raise TableError("select of a group takes Key and aggregates")
        names = dict.fromkeys([self.column, *(a.column for a in outputs.values() if isinstance(a, Aggregate) and a.column), *([self.per_shard] if self.per_shard else [])])
        rows = q.select(*names)
        shard = [self.per_shard] if self.per_shard else []
        grouped = rows.groupBy(*shard, self.column)
        out = grouped.agg(*aggregates) if aggregates else rows.select(*shard, self.column).distinct()
        return out.select(*shard, *(F.col(f"`{self.column}`").alias(k) for k in keys), *(n for n, x in outputs.items() if isinstance(x, Aggregate)))
