"""The engine's operators as named queries over the driver's tables, with their SQL.

Every callable takes (spark, sf_dir) and returns a DataFrame.  Sums of doubles are
taken over two-decimal numbers, so that their order does not show.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import SEPARATORS
from .operators import Query, avg, count, count_distinct, max_, min_, sum_
from .plans import commands
from .plans.predicate import Fields
from .sources import Entity, ShardedTable, Store
from .sources.folders import scratch_root
from .streaming import Queue, QueueFull

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
f = Fields()
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id"}
SEARCH = {"documents": {"text": "words"}, "part": {"p_name": "words"}}
DAY = dt.datetime


def table(spark: SparkSession, sf_dir: str, name: str, search: dict[str, str] | None = None) -> Query:
    return Query.over(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name], SEARCH.get(name, {}) if search is None else search)


def add(name: str, source: str, make: Callable[[Query], DataFrame], sql: str, search: dict[str, str] | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(table(spark, sf_dir, source, search))
    SQL[name] = sql


def decimal(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


# -- projections -----------------------------------------------------------------
add("flagship", "orders", lambda q: q.between("o_orderdate", DAY(1995, 1, 1), DAY(1996, 12, 31)).order_by("o_totalprice", True).take(10).select("o_orderkey", "o_custkey", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
add("select_columns", "orders", lambda q: q.select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders")
add("select_rename", "orders", lambda q: q.select("o_orderkey", price="o_totalprice", day=f.o_orderdate), "SELECT o_orderkey, o_totalprice AS price, o_orderdate AS day FROM orders")
add("select_entity", "nation", lambda q: q.select_entity(), "SELECT * FROM nation")

# -- comparisons -----------------------------------------------------------------
PART, CUST, LINE, ORD = ("p_partkey", "p_size"), ("c_custkey", "c_mktsegment", "c_acctbal"), ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ("o_orderkey", "o_totalprice", "o_orderdate")
P, C, L, O = (", ".join(x) for x in (PART, CUST, LINE, ORD))
add("where_eq_int", "part", lambda q: q.where(f.p_size == 15).select(*PART), f"SELECT {P} FROM part WHERE p_size = 15")
add("where_eq_str_ci", "customer", lambda q: q.where(f.c_mktsegment == "machinery").select(*CUST), f"SELECT {C} FROM customer WHERE lower(c_mktsegment) = 'machinery'")
add("where_eq_null", "customer", lambda q: q.where(f.c_mktsegment == None).select(*CUST), f"SELECT {C} FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment = ''")  # noqa: E711
add("where_ne_null", "customer", lambda q: q.where(f.c_acctbal != None).select(*CUST), f"SELECT {C} FROM customer WHERE c_acctbal IS NOT NULL")  # noqa: E711
add("where_ne_int", "part", lambda q: q.where(f.p_size != 15).select(*PART), f"SELECT {P} FROM part WHERE p_size IS DISTINCT FROM 15")
add("where_ne_str_ci", "customer", lambda q: q.where(f.c_mktsegment != "Machinery").select(*CUST), f"SELECT {C} FROM customer WHERE lower(c_mktsegment) IS DISTINCT FROM 'machinery'")
add("where_lt", "lineitem", lambda q: q.where(f.l_quantity < 10).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity < 10")
add("where_le", "lineitem", lambda q: q.where(f.l_quantity <= 10).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity <= 10")
add("where_gt", "lineitem", lambda q: q.where(f.l_quantity > 40).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity > 40")
add("where_ge", "lineitem", lambda q: q.where(f.l_quantity >= 40).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity >= 40")
add("where_negative", "customer", lambda q: q.where(f.c_acctbal < -100.5).select(*CUST), f"SELECT {C} FROM customer WHERE c_acctbal < -100.5")
add("where_date", "orders", lambda q: q.where(f.o_orderdate >= DAY(1997, 1, 1)).select(*ORD), f"SELECT {O} FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
add("where_and", "lineitem", lambda q: q.where((f.l_quantity > 30) & (f.l_discount <= 0.03)).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.03")
add("where_or", "lineitem", lambda q: q.where((f.l_quantity > 45) | (f.l_quantity < 3)).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity > 45 OR l_quantity < 3")
add("where_logical_chain", "lineitem", lambda q: q.where(((f.l_quantity > 45) | (f.l_quantity < 3)) & ((f.l_returnflag == "r") | (f.l_linestatus == "O"))).select(*LINE), f"SELECT {L} FROM lineitem WHERE (l_quantity > 45 OR l_quantity < 3) AND (lower(l_returnflag) = 'r' OR lower(l_linestatus) = 'o')")
add("where_chained", "lineitem", lambda q: q.where(f.l_quantity > 30).where(f.l_linenumber == 2).where(f.l_tax < 0.05).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity > 30 AND l_linenumber = 2 AND l_tax < 0.05")
add("or_operator", "lineitem", lambda q: q.where(f.l_quantity > 45).or_().between("l_extendedprice", 100, 2000).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity > 45 OR l_extendedprice BETWEEN 100 AND 2000")
add("or_chain_binding", "lineitem", lambda q: q.where(f.l_linenumber == 1).where(f.l_quantity > 45).or_().where(f.l_quantity < 5).where(f.l_tax > 0.02).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_linenumber = 1 AND (l_quantity > 45 OR l_quantity < 5) AND l_tax > 0.02")

# -- ranges and membership -------------------------------------------------------
for name, bounds, low, high in (("both_incl", "[]", ">=", "<="), ("from_incl", "[)", ">=", "<"), ("to_incl", "(]", ">", "<="), ("excl", "()", ">", "<")):
    add(f"between_{name}", "lineitem", lambda q, bounds=bounds: q.between("l_quantity", 10, 20, bounds).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity {low} 10 AND l_quantity {high} 20")
add("between_mixed_sign", "customer", lambda q: q.between("c_acctbal", -500, 500).select(*CUST), f"SELECT {C} FROM customer WHERE c_acctbal BETWEEN -500 AND 500")
add("between_dates", "lineitem", lambda q: q.between("l_shipdate", DAY(1996, 3, 1), DAY(1996, 4, 1), "[)").select(*LINE, "l_shipdate"), f"SELECT {L}, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01'")
add("between_multi", "lineitem", lambda q: q.between("l_quantity", 10, 20).between("l_discount", 0.02, 0.05).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05")
add("between_reversed", "lineitem", lambda q: q.between("l_quantity", 20, 10).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity BETWEEN 20 AND 10")
add("intersect_int", "part", lambda q: q.intersect("p_size", [1, 5, 7, 49]).select(*PART), f"SELECT {P} FROM part WHERE p_size IN (1, 5, 7, 49)")
add("intersect_double", "lineitem", lambda q: q.intersect("l_discount", [0.01, 0.07]).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_discount IN (0.01, 0.07)")
add("intersect_date", "orders", lambda q: q.intersect("o_orderdate", [DAY(1995, 5, d) for d in range(1, 20)]).select(*ORD), "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate IN (" + ", ".join(f"TIMESTAMP '1995-05-{d:02}'" for d in range(1, 20)) + ")")
add("intersect_str_ci", "customer", lambda q: q.intersect("c_mktsegment", ["building", "MACHINERY", None]).select(*CUST), f"SELECT {C} FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') OR c_mktsegment IS NULL OR c_mktsegment = ''")
add("intersect_large", "orders", lambda q: q.intersect("o_orderkey", range(0, 60_000, 3)).select(*ORD), f"SELECT {O} FROM orders WHERE o_orderkey IN (SELECT range FROM range(0, 60000, 3))")
add("intersect_large_double", "lineitem", lambda q: q.intersect("l_quantity", range(5, 20_005)).select(*LINE), f"SELECT {L} FROM lineitem WHERE l_quantity BETWEEN 5 AND 20004 AND l_quantity = floor(l_quantity)")
add("intersect_large_mixed", "part", lambda q: q.intersect("p_size", [k / 2 for k in range(20, 20_100)]).select(*PART), f"SELECT {P} FROM part WHERE p_size BETWEEN 10 AND 10049")
add("intersect_id", "part", lambda q: q.intersect(None, [3, 5, 8, 13]).select(*PART), f"SELECT {P} FROM part WHERE p_partkey IN (3, 5, 8, 13)")
add("all_ids", "part", lambda q: q.where(f.p_size > 0).get_ids().ids.withColumn("all_ids", F.lit(q.where(f.p_size > 0).get_ids().all_ids)), "SELECT p_partkey, (SELECT min(p_size) FROM part) > 0 AS all_ids FROM part WHERE p_size > 0")
QUERIES["intersect_subquery"] = lambda spark, d: table(spark, d, "orders").intersect("o_custkey", table(spark, d, "customer").where(f.c_acctbal < 0)).select(*ORD)
SQL["intersect_subquery"] = f"SELECT {O} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
QUERIES["intersect_or_subquery"] = lambda spark, d: table(spark, d, "orders").intersect("o_custkey", table(spark, d, "customer").where(f.c_acctbal < -900)).or_().where(f.o_totalprice < 2000).select(*ORD)
SQL["intersect_or_subquery"] = f"SELECT {O} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900) OR o_totalprice < 2000"

# -- order and paging ------------------------------------------------------------
add("order_asc", "orders", lambda q: q.order_by("o_totalprice").take(25).select(*ORD), f"SELECT {O} FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 25")
add("order_desc", "orders", lambda q: q.order_by_descending("o_totalprice").take(25).select(*ORD), f"SELECT {O} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 25")
add("order_negative", "customer", lambda q: q.order_by("c_acctbal").take(30).select(*CUST), f"SELECT {C} FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 30")
add("order_date", "orders", lambda q: q.order_by("o_orderdate").take(30).select(*ORD), f"SELECT {O} FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 30")
add("order_string_ci", "customer", lambda q: q.order_by("c_mktsegment").take(40).select(*CUST), f"SELECT {C} FROM customer ORDER BY lower(nullif(c_mktsegment, '')) NULLS FIRST, c_custkey LIMIT 40")
add("order_by_id", "orders", lambda q: q.order_by("o_orderkey", True).take(15).select(*ORD), f"SELECT {O} FROM orders ORDER BY o_orderkey DESC LIMIT 15")
add("skip_take", "orders", lambda q: q.where(f.o_orderstatus == "F").order_by("o_totalprice").take(20).skip(10).select(*ORD), f"SELECT {O} FROM orders WHERE lower(o_orderstatus) = 'f' ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 20 OFFSET 10")
add("take_desc", "part", lambda q: q.order_by("p_retailprice", True).take(10).select("p_partkey", "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey DESC LIMIT 10")
add("take_zero", "part", lambda q: q.order_by("p_retailprice").take(0).select("p_partkey"), "SELECT p_partkey FROM part LIMIT 0")
add("skip_only", "customer", lambda q: q.order_by("c_acctbal").skip(100).select(*CUST), f"SELECT {C} FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey OFFSET 100")


def _statistics(q: Query) -> DataFrame:
    page, _ = q.where(f.o_totalprice > 100_000).order_by("o_totalprice").skip(5).take(10).select_with_statistics("o_orderkey")
    total = q.where(f.o_totalprice > 100_000).matches().agg(F.count(F.lit(1)).alias("total"))
    both = total.unionByName(page.agg(F.count(F.lit(1)).alias("returned")), allowMissingColumns=True)
    return both.agg(F.max("total").alias("total"), F.max("returned").alias("returned"))


add("stat_total", "orders", _statistics, "SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS total, (SELECT count(*) FROM (SELECT 1 FROM orders WHERE o_totalprice > 100000 LIMIT 10 OFFSET 5)) AS returned")
add("count_all", "lineitem", lambda q: q.matches().agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem")
add("count_filtered", "lineitem", lambda q: q.where(f.l_quantity > 25).matches().agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
add("get_ids", "customer", lambda q: q.where(f.c_acctbal > 5000).get_ids().ids, "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
add("last_step", "orders", lambda q: q.last_step_frame(), "SELECT CAST(max(o_orderkey) // 1000 AS BIGINT) AS last_step FROM orders")

# -- groups ----------------------------------------------------------------------
add("group_count", "lineitem", lambda q: q.group_by("l_linenumber").select(k="Key", n=count()), "SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1")
add("group_keys", "customer", lambda q: q.group_by("c_nationkey").select(k="Key"), "SELECT DISTINCT c_nationkey AS k FROM customer")
add("group_sum", "part", lambda q: q.group_by("p_size").select(k="Key", s=sum_("p_partkey")), "SELECT p_size AS k, CAST(sum(p_partkey) AS BIGINT) AS s FROM part GROUP BY 1")
add("group_sum_double", "customer", lambda q: Query.over(decimal(q.frame, "c_acctbal"), "c_custkey").group_by("c_nationkey").select(k="Key", s=sum_("c_acctbal")), "SELECT c_nationkey AS k, sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS s FROM customer GROUP BY 1")
add("group_min_max", "customer", lambda q: q.group_by("c_nationkey").select(k="Key", low=min_("c_acctbal"), high=max_("c_acctbal")), "SELECT c_nationkey AS k, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
add("group_avg", "lineitem", lambda q: q.group_by("l_linenumber").select(k="Key", a=avg("l_linenumber")), "SELECT l_linenumber AS k, avg(l_linenumber) AS a FROM lineitem GROUP BY 1")
add("group_count_distinct", "lineitem", lambda q: q.group_by("l_linenumber").select(k="Key", n=count_distinct("l_partkey")), "SELECT l_linenumber AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
add("group_all", "part", lambda q: q.group_by("p_size").select(k="Key", n=count(), d=count_distinct("p_retailprice"), s=sum_("p_size"), low=min_("p_retailprice"), high=max_("p_retailprice"), a=avg("p_size")), "SELECT p_size AS k, count(*) AS n, count(DISTINCT p_retailprice) AS d, CAST(sum(p_size) AS BIGINT) AS s, min(p_retailprice) AS low, max(p_retailprice) AS high, avg(p_size) AS a FROM part GROUP BY 1")
add("group_where", "lineitem", lambda q: q.where(f.l_quantity > 20).between("l_discount", 0.02, 0.06).group_by("l_linenumber").select(k="Key", n=count()), "SELECT l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_quantity > 20 AND l_discount BETWEEN 0.02 AND 0.06 GROUP BY 1")
add("group_empty", "lineitem", lambda q: q.where(f.l_quantity < -1).group_by("l_linenumber").select(k="Key", n=count()), "SELECT l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_quantity < -1 GROUP BY 1")

# -- search ----------------------------------------------------------------------
_CLASS = "[" + "".join("\\" + c if c.isascii() and not c.isalnum() and c not in " _" else c for c in SEPARATORS) + "]"
_CLASS = _CLASS.replace("'", "''")


def _has(word: str, kind: str = "words", column: str = "text", prefix: bool = False) -> str:
    """The condition in SQL."""
    space = f"string_split_regex(lower({column}), '\\s+')"
    fine = f"list_transform(string_split_regex(lower({column}), '{_CLASS}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    found = f"list_filter({f'list_concat({space}, {fine})' if kind == 'words' else space}, lambda x: x <> '')"
    return f"len(list_filter({found}, lambda x: starts_with(x, '{word}'))) > 0" if prefix else f"list_contains({found}, '{word}')"


D = "SELECT doc_id, source FROM documents WHERE "
add("search_word", "documents", lambda q: q.search("text", "license").select("doc_id", "source"), D + _has("license"))
add("search_multi_word", "documents", lambda q: q.search("text", "under license released").select("doc_id", "source"), D + " AND ".join(map(_has, ("under", "license", "released"))))
add("search_case", "documents", lambda q: q.search("text", "LiCeNsE mit").select("doc_id", "source"), D + _has("license") + " AND " + _has("mit"))
add("search_punctuation", "documents", lambda q: q.search("text", "license.").select("doc_id", "source"), D + _has("license."))
add("search_spaces_only", "documents", lambda q: q.search("text", "license.").select("doc_id", "source"), D + _has("license.", "spaces"), {"text": "spaces"})
add("search_empty", "documents", lambda q: q.search("text", "").select("doc_id", "source"), "SELECT doc_id, source FROM documents")
add("search_blank", "documents", lambda q: q.search("text", "  ").select("doc_id", "source"), D + "false")
add("search_prefix", "documents", lambda q: q.search_partial("text", "licens").select("doc_id", "source"), D + _has("licens", prefix=True))
add("search_prefix_multi", "documents", lambda q: q.search_partial("text", "lic rele").select("doc_id", "source"), D + _has("lic", prefix=True) + " AND " + _has("rele", prefix=True))
add("search_steps", "documents", lambda q: q.search("text", "the", 0, 1).select("doc_id", "source"), D + "doc_id < 1000 AND " + _has("the"))
add("search_or_search", "documents", lambda q: q.search("text", "license").or_().search("text", "token").select("doc_id", "source"), D + "(" + _has("license") + " OR " + _has("token") + ")")
add("search_and_where", "documents", lambda q: q.search("text", "the").where(f.lang == "EN").between("n_chars", 500, 2000).select("doc_id", "source"), D + "lower(lang) = 'en' AND n_chars BETWEEN 500 AND 2000 AND " + _has("the"))
add("search_part_name", "part", lambda q: q.search("p_name", "steel").or_().search_partial("p_name", "cop").select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE " + _has("steel", column="p_name") + " OR " + _has("cop", column="p_name", prefix=True))
add("search_time_limited", "documents", lambda q: q.search_time_limited("text", "license", 3_600_000).select("doc_id", "source"), D + _has("license"))



def _cut_off(q: Query) -> DataFrame:
    """No time at all: the first five steps of ids."""
    found = q.search_time_limited("l_returnflag", "r", 0)
    _, stats = found.select_with_statistics("l_orderkey")
    return found.select("l_orderkey", "l_linenumber").withColumn("whole", F.lit(stats.searched_percentile >= 100))


add("search_time_limited_cut", "lineitem", _cut_off, "SELECT l_orderkey, l_linenumber, (SELECT max(l_orderkey) FROM lineitem) < 5000 AS whole FROM lineitem WHERE lower(l_returnflag) = 'r' AND l_orderkey < 5000", {"l_returnflag": "words"})

add("group_sum_int32", "lineitem", lambda q: q.group_by("l_linenumber", compat_int32=True).select(k="Key", total=sum_("l_linenumber")), "SELECT l_linenumber AS k, CAST(((sum(l_linenumber) + 2147483648) % 4294967296) - 2147483648 AS INT) AS total FROM lineitem GROUP BY 1")

# -- managed tables --------------------------------------------------------------
CUSTOMER = Entity("Customer", {"Id": "long", "Name": "string", "Nation": "int", "Balance": "double", "SegmentSearch": "string"})
COLUMNS = ("Id", "Name", "Nation", "Balance", "SegmentSearch")
BASE = "SELECT c_custkey + 1 AS Id, c_name AS Name, c_nationkey AS Nation, c_acctbal AS Balance, c_mktsegment AS SegmentSearch FROM customer"


def _store(spark: SparkSession, sf_dir: str, entity: Entity = CUSTOMER):
    """A store with all customers; ids begin at 1."""
    store = Store(spark, scratch_root(spark))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    store.table(entity).save_batch(customers.select((F.col("c_custkey") + 1).alias("Id"), F.col("c_name").alias("Name"), F.col("c_nationkey").alias("Nation"), F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("SegmentSearch")))
    return store, store.table(entity)


def managed(name: str, sql: str):
    def register(change):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            store, t = _store(spark, sf_dir)
            return change(store, t) or store.table(CUSTOMER).select(*COLUMNS)

        QUERIES[name], SQL[name] = run, sql
        return change

    return register


@managed("write_upsert", f"SELECT * FROM ({BASE}) WHERE Id NOT IN (1, 2) UNION ALL SELECT * FROM (VALUES (1, 'new one', 3, -1.5, NULL), (2, 'new two', 4, 0.0, 'x'), (5000000, 'far', 0, 7.25, 'y')) AS v")
def _upsert(store: Store, t):
    t.save_batch([{"Id": 1, "Name": "new one", "Nation": 3, "Balance": -1.5, "SegmentSearch": ""}, {"Id": 2, "Name": "new two", "Nation": 4, "Balance": 0.0, "SegmentSearch": "x"}, {"Id": 2, "Name": "late", "Nation": 4, "Balance": 0.0, "SegmentSearch": "x"}, {"Id": 5_000_000, "Name": "far", "Nation": 0, "Balance": 7.25, "SegmentSearch": "y"}])


@managed("write_update", f"SELECT Id, CASE Id WHEN 7 THEN NULL ELSE Name END AS Name, Nation, CASE WHEN Id IN (3, 4) THEN Id * 100.5 ELSE Balance END AS Balance, SegmentSearch FROM ({BASE})")
def _update(store: Store, t):
    t.update("Balance", {3: 301.5, 4: 402.0, 999_999_999: 1.0})
    t.update("Name", 7, None)


@managed("write_delete", f"SELECT * FROM ({BASE}) WHERE Id NOT IN (1, 5, 9)")
def _delete(store: Store, t):
    t.delete({1, 5, 9, 123_456_789})


@managed("write_increment", f"SELECT Id, Name, CASE Id WHEN 10 THEN -2147483648 WHEN 11 THEN Nation + 5 ELSE Nation END AS Nation, Balance, SegmentSearch FROM ({BASE})")
def _increment(store: Store, t):
    new = {"Id": 0, "Name": "none", "Nation": 0, "Balance": 0.0, "SegmentSearch": None}
    t.update("Nation", 10, 2**31 - 1)
    t.atomic_increment("Nation", 1, new, t.where(f.Id == 10))
    t.atomic_increment("Nation", 5, new, t.where(f.Id == 11))
    t.atomic_increment("Nation", 5, new, t.where(f.Id == 12), only_if_old_equal=-77)


@managed("txn_multi_table", f"SELECT Id, CASE Id WHEN 3 THEN 'changed' ELSE Name END AS Name, Nation, Balance, SegmentSearch FROM ({BASE}) WHERE Id <> 2 UNION ALL SELECT 1, 'a note', NULL, NULL, NULL")
def _transaction(store: Store, t):
    note = Entity("Note", {"Id": "long", "Text": "string"})
    with store.transaction() as tran:
        store.table(CUSTOMER, tran).update("Name", 3, "changed")
        store.table(CUSTOMER, tran).delete(2)
        store.table(note, tran).save({"Id": 0, "Text": "a note"})
        tran.commit()
    with store.transaction() as dropped:
        store.table(CUSTOMER, dropped).delete(4)
    notes = store.table(note).select("Id", Name="Text")
    return store.table(CUSTOMER).select(*COLUMNS).unionByName(notes, allowMissingColumns=True)


WIDER = Entity("Customer", {**CUSTOMER.columns, "Rank": "int", "Since": "datetime"})


@managed("evolve_default_on_read", f"SELECT Id, Rank, CAST(Since AS VARCHAR) AS Since FROM (SELECT Id, 0 AS Rank, TIMESTAMP '0001-01-01' AS Since FROM ({BASE}) WHERE Id <> 8 UNION ALL SELECT 8, NULL, TIMESTAMP '2020-02-02' UNION ALL SELECT 6000000, 5, TIMESTAMP '2021-01-01')")
def _evolve(store: Store, t):
    rest = {"Name": "n", "Nation": 1, "Balance": 1.0, "SegmentSearch": "s"}
    store.table(WIDER).save_batch([{"Id": 8, **rest, "Rank": None, "Since": DAY(2020, 2, 2)}, {"Id": 6_000_000, **rest, "Rank": 5, "Since": DAY(2021, 1, 1)}])
    return store.table(WIDER).select("Id", "Rank", "Since").withColumn("Since", F.col("Since").cast("string"))


@managed("evolve_gap_not_matched", "SELECT CAST(6000000 AS BIGINT) AS Id, 0 AS Rank UNION ALL SELECT 6000001, NULL")
def _gaps(store: Store, t):
    rest = {"Name": "n", "Nation": 1, "Balance": 1.0, "SegmentSearch": "s", "Since": None}
    w = store.table(WIDER)
    w.save_batch([{"Id": 6_000_000, **rest, "Rank": 0}, {"Id": 6_000_001, **rest, "Rank": None}])
    return w.where((f.Rank == 0) | (f.Rank == None)).select("Id", "Rank")  # noqa: E711


@managed("replicate_roundtrip", BASE)
def _replicate(store: Store, t):
    target = scratch_root(store.spark)
    store.replicate(target)
    t.delete({1})
    return Store(store.spark, target).table(CUSTOMER).select(*COLUMNS)


@managed("memory_index_group", "SELECT c_nationkey AS k, count(*) AS n, max(c_acctbal) AS high FROM customer GROUP BY 1")
def _indexed(store: Store, t):
    t.create_group_index("Nation", "Balance")
    t.create_property_index("Balance")
    t.remove_property_index("Balance")
    return t.group_by("Nation", strict_indexes=True).select(k="Key", n=count(), high=max_("Balance"))


@managed("memory_index_where", f"SELECT * FROM ({BASE}) WHERE Nation = 3 OR Nation > 20 AND Nation <> 22 AND Balance >= 0")
def _indexed_where(store: Store, t):
    t.create_property_index("Nation")
    return t.where((f.Nation == 3) | ((f.Nation > 20) & (f.Nation != 22) & (f.Balance >= 0.0))).select(*COLUMNS)


@managed("memory_index_order", f"SELECT * FROM ({BASE}) WHERE Nation IN (1, 2, 3) ORDER BY Balance, Id LIMIT 25 OFFSET 5")
def _indexed_order(store: Store, t):
    t.create_property_index("Balance")
    return t.intersect("Nation", [1, 2, 3]).order_by("Balance").skip(5).take(25).select(*COLUMNS)


@managed("write_increment_2", f"SELECT Id, Name, CASE Id WHEN 10 THEN Nation + 2 ELSE Nation END AS Nation, Balance, SegmentSearch FROM ({BASE})")
def _increment_2(store: Store, t):
    pair = Entity("Customer", {**CUSTOMER.columns, "Visits": "int"})
    wide = store.table(pair)
    wide.update("Visits", 10, 40)
    wide.atomic_increment_2("Nation", "Visits", 2, 1, {"Id": 0}, wide.where(f.Id == 10))
    if [r["Visits"] for r in wide.where(f.Id == 10).select("Visits").collect()] != [41]:
        raise ValueError("the second column was not increased")


@managed("write_two_handles", f"SELECT * FROM ({BASE}) WHERE Id <> 2 UNION ALL SELECT * FROM (VALUES (7000001, 'one', 1, 1.5, 'a'), (7000002, 'two', 2, 2.5, 'b'), (7000003, 'three', 3, 3.5, 'c')) AS v")
def _two_handles(store: Store, t):
    other = Store(store.spark, store.files.root).table(CUSTOMER)
    row = lambda i, n, k: {"Id": i, "Name": n, "Nation": k, "Balance": k + 0.5, "SegmentSearch": "abc"[k - 1]}
    t.save(row(7_000_001, "one", 1))
    other.save(row(7_000_002, "two", 2))
    t.save(row(7_000_003, "three", 3))
    other.delete(2)


@managed("write_non_atomically", f"SELECT * FROM ({BASE}) WHERE Id NOT IN (1, 2) AND Id <> 4 UNION ALL SELECT Id, Name, Nation, -0.5, SegmentSearch FROM ({BASE}) WHERE Id = 4")
def _non_atomically(store: Store, t):
    t.update_non_atomically("Balance", {4: -0.5}, 1)
    t.delete_non_atomically([1, 2], 1)
    rows = [tuple(r) for r in t.query().select_non_atomically(*COLUMNS, batch_size=100)]
    return store.spark.createDataFrame(rows, "Id long, Name string, Nation int, Balance double, SegmentSearch string")


@managed("request_plan", f"SELECT Id, Name AS who FROM ({BASE}) WHERE (Nation = 3 OR Balance < 0) AND Balance BETWEEN -500 AND 500 ORDER BY Balance DESC, Id DESC LIMIT 20")
def _request(store: Store, t):
    text = commands.dumps([{"do": "where", "condition": (f.Nation == 3) | (f.Balance < 0.0)}, {"do": "between", "column": "Balance", "low": -500, "high": 500}, {"do": "orderdesc", "column": "Balance"}, {"do": "take", "n": 20}, {"do": "select", "columns": ["Id"], "renamed": {"who": "Name"}}])
    return commands.run(t, text, commands.Role.READER)


@managed("table_definitions", "SELECT 'Customer' AS name, 'public class Customer { public int Id { get; set; } public string Name { get; set; } public int? Nation { get; set; } public double? Balance { get; set; } public string SegmentSearch { get; set; }  } ' AS definition")
def _definitions(store: Store, t):
    return store.spark.createDataFrame([(n, store.table_definition(n)) for n in store.tables()], "name string, definition string")


SHARDED = Entity("Shop", {"Id": "long", "Sid": "int", "Nation": "int", "Balance": "double"})
_SHARDS = "SELECT s_suppkey + 1 AS Id, CAST(s_suppkey % 3 AS INT) AS Sid, s_nationkey AS Nation, s_acctbal AS Balance FROM supplier"


def _sharded(spark: SparkSession, sf_dir: str) -> ShardedTable:
    shops = ShardedTable(Store(spark, scratch_root(spark)), SHARDED, [0, 1, 2])
    shops.table.save_batch(spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("Id"), (F.col("s_suppkey") % 3).cast("int").alias("Sid"), F.col("s_nationkey").alias("Nation"), F.col("s_acctbal").alias("Balance")))
    return shops


QUERIES["sharded_group"] = lambda spark, d: _sharded(spark, d).group_by("Nation").select(k="Key", n=count(), high=max_("Balance"))
SQL["sharded_group"] = f"SELECT Nation AS k, count(*) AS n, max(Balance) AS high FROM ({_SHARDS}) GROUP BY 1"
QUERIES["sharded_group_per_shard"] = lambda spark, d: _sharded(spark, d).per_shard("Nation").select(k="Key", n=count())
SQL["sharded_group_per_shard"] = f"SELECT Sid, Nation AS k, count(*) AS n FROM ({_SHARDS}) GROUP BY 1, 2"
QUERIES["sharded_top_k"] = lambda spark, d: _sharded(spark, d).order_by("Balance", True).take(10).select("Id", "Sid", "Balance")
SQL["sharded_top_k"] = f"SELECT Id, Sid, Balance FROM ({_SHARDS}) ORDER BY Balance DESC NULLS LAST, Id DESC LIMIT 10"


QUERIES["sharded_some_shards"] = lambda spark, d: _sharded(spark, d).on_shards(0, 2).where(f.Balance < 0).select("Id", "Sid", "Balance")
SQL["sharded_some_shards"] = f"SELECT Id, Sid, Balance FROM ({_SHARDS}) WHERE Sid IN (0, 2) AND Balance < 0"


def _sharded_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows change under their (Sid, Id) only; the last keys name other shards."""
    shops = _sharded(spark, d)
    shops.save({"Id": 2, "Sid": 1, "Nation": 7, "Balance": 1.5})
    shops.save_batch([{"Id": 3, "Sid": 2, "Nation": 8, "Balance": 2.5}])
    shops.update("Balance", {(0, 4): 4.5, (1, 5): 5.5, (1, 7): 99.0})
    shops.delete([(2, 6), (0, 8)])
    return shops.select("Id", "Sid", "Nation", "Balance")


QUERIES["sharded_changes"] = _sharded_changes
SQL["sharded_changes"] = f"SELECT Id, Sid, CASE Id WHEN 2 THEN 7 WHEN 3 THEN 8 ELSE Nation END AS Nation, CASE Id WHEN 2 THEN 1.5 WHEN 3 THEN 2.5 WHEN 4 THEN 4.5 WHEN 5 THEN 5.5 ELSE Balance END AS Balance FROM ({_SHARDS}) WHERE Id <> 6"


def _queue(spark: SparkSession, _: str) -> DataFrame:
    queue, refused = Queue(), 0
    for i in range(500):
        try:
            queue.put((i, f"item {i}"))
        except QueueFull:
            refused += 1
    return queue.drain(spark, "n long, item string").withColumn("refused", F.lit(refused).cast("long"))


QUERIES["queue_drain"] = _queue
SQL["queue_drain"] = "SELECT range AS n, 'item ' || range AS item, CAST(201 AS BIGINT) AS refused FROM range(0, 299)"
