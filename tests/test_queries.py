"""Predicates, ranges, search, order and groups on small fixtures."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallgrass.errors import TableError
from tallgrass.operators import Query, avg, count, count_distinct, max_, min_, sum_
from tallgrass.plans import commands
from tallgrass.plans.predicate import Fields

f = Fields()
SCHEMA = "Id int, PeriodId int, ObjectId int, Value double, Normalized double, Date timestamp_ntz, NameSearch string, NameSearchS string, NotSearchable string, Data binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def make(spark):
    def build(*rows):
        return Query.over(spark.createDataFrame([tuple(r.get(n, 0 if n == "PeriodId" else None) for n in NAMES) for r in rows], SCHEMA))

    return build


def periods(q):
    return sorted(r[0] for r in (q.select("PeriodId") if isinstance(q, Query) else q).collect())


def ids(q):
    return sorted(r[0] for r in q.select("Id").collect())


@pytest.fixture(scope="module")
def numbers(make):
    return make(*({"Id": i, "Normalized": n, "PeriodId": p} for i, (n, p) in enumerate([(1.2, 5), (-0.9, 7), (0.0, 0), (0.5, -10), (4.5, -15), (None, 3)], 1)))


def test_comparisons_know_null_and_sign(numbers):
    assert ids(numbers.where(f.Normalized == None)) == [6]  # noqa: E711
    assert ids(numbers.where(f.Normalized != None)) == [1, 2, 3, 4, 5]  # noqa: E711
    assert ids(numbers.where(f.Normalized != 0.5)) == [1, 2, 3, 5, 6]
    assert ids(numbers.where(f.PeriodId != 5)) == [2, 3, 4, 5, 6]
    assert ids(numbers.where(f.Normalized < 0)) == [2]
    assert ids(numbers.where(f.Normalized <= 0)) == [2, 3]
    assert ids(numbers.where(f.Normalized > 0.5)) == [1, 5]
    assert ids(numbers.where(f.Normalized >= 0.5)) == [1, 4, 5]


def test_between(numbers):
    assert ids(numbers.between("Normalized", -0.9, 0.5)) == [2, 3, 4]
    assert ids(numbers.between("Normalized", -0.9, 0.5, "()")) == [3]
    assert ids(numbers.between("Normalized", -0.9, 0.5, "[)")) == [2, 3]
    assert ids(numbers.between("Normalized", -0.9, 0.5, "(]")) == [3, 4]
    assert ids(numbers.between("Normalized", 2, 1)) == []
    assert ids(numbers.between("Normalized", 0, 5).between("PeriodId", -15, -1)) == [4, 5]


def test_or_binds_tighter_than_and(numbers):
    q = numbers.where(f.PeriodId > -12).where(f.Normalized > 1).or_().where(f.PeriodId == 7).where(f.Normalized < 2)
    assert ids(q) == [1, 2]
    with pytest.raises(TableError):
        numbers.where(f.PeriodId > 1).or_().select("Id")
    with pytest.raises(TableError):
        numbers.or_()


def test_intersect(numbers, spark):
    assert ids(numbers.intersect("PeriodId", [5, 7, 99])) == [1, 2]
    assert ids(numbers.intersect("Normalized", [0.5, None])) == [4, 6]
    assert ids(numbers.intersect("Normalized", [])) == []
    assert ids(numbers.intersect(None, [1, 3])) == [1, 3]
    assert ids(numbers.intersect("Id", range(0, 30_000, 2))) == [2, 4, 6]
    assert ids(numbers.intersect("Normalized", range(-5, 20_000))) == [3]
    assert ids(numbers.intersect("PeriodId", [k / 2 for k in range(20_000)])) == [1, 2, 3, 6]
    assert ids(numbers.intersect("Normalized", [None, 0.5, *range(100, 20_000)])) == [4, 6]
    with pytest.raises(TableError):
        numbers.intersect("Id", [*range(20_000), "a"])
    assert ids(numbers.intersect("Id", numbers.where(f.PeriodId < 0))) == [4, 5]
    frame = spark.createDataFrame([(0.5,), (0.5,), (None,)], "v double")
    assert ids(numbers.intersect("Normalized", frame)) == [4, 6]
    assert ids(numbers.intersect("Normalized", frame).or_().where(f.PeriodId == 5)) == [1, 4, 6]


def test_strings_have_no_case_and_empty_is_null(make):
    q = make({"Id": 1, "NameSearch": "ПриВеТ Как ДелА"}, {"Id": 2, "NameSearch": ""}, {"Id": 3}, {"Id": 4, "NameSearch": "Ab"})
    assert ids(q.where(f.NameSearch == "привет как дела")) == [1]
    assert ids(q.where(f.NameSearch != "AB")) == [1, 2, 3]
    assert ids(q.where(f.NameSearch == "")) == ids(q.where(f.NameSearch == None)) == [2, 3]  # noqa: E711
    assert ids(q.where(f.NameSearch != "")) == ids(q.where(f.NameSearch != None)) == [1, 4]  # noqa: E711
    assert ids(q.intersect("NameSearch", ["aB", None])) == [2, 3, 4]
    assert q.where(f.Id == 1).select("NameSearch").first()[0] == "ПриВеТ Как ДелА"


def test_search(make):
    q = make({"Id": 1, "NameSearch": "test 123 abc"}, {"Id": 2, "NameSearch": "test"}, {"Id": 3}, {"Id": 4, "NameSearch": "привет"}, {"Id": 1500, "NameSearch": "test@abc", "NameSearchS": "test@abc (foo\nbar)"})
    assert ids(q.search("NameSearch", "test")) == [1, 2, 1500]
    assert ids(q.search("NameSearch", "TEST abc")) == [1, 1500]
    assert ids(q.search("NameSearch", "test@abc")) == [1500]
    assert ids(q.search("NameSearchS", "abc")) == []
    assert ids(q.search("NameSearchS", "(foo bar)")) == [1500]
    assert ids(q.search("NameSearch", "")) == [1, 2, 3, 4, 1500]
    assert ids(q.search("NameSearch", "  ")) == []
    assert ids(q.search("NameSearch", "test", 0, 1)) == [1, 2]
    assert ids(q.search("NameSearch", "test", 1, 1)) == [1500]
    assert ids(q.search_partial("NameSearch", "te ab")) == [1, 1500]
    assert ids(q.search_partial("NameSearch", "прив")) == [4]
    assert ids(q.search_partial("NameSearch", "прива")) == []
    limited = q.search_time_limited("NameSearch", "test", 60_000)
    assert ids(limited) == [1, 2, 1500] and limited.select_with_statistics("Id")[1].searched_percentile == 100
    for bad in (lambda: q.search("NotSearchable", "x"), lambda: q.search("NameSearch", "x", 1)):
        with pytest.raises(TableError):
            bad()


def test_tokens_keep_line_breaks_of_the_second_split(make):
    q = make({"Id": 1, "NameSearch": "(foo\nbar)"})
    assert ids(q.search("NameSearch", "(foo")) == ids(q.search("NameSearch", "bar)")) == [1]
    assert ids(q.search("NameSearch", "foo")) == []


def test_order_and_paging(numbers, make):
    q = make(*({"Id": i, "Normalized": n, "PeriodId": p} for i, (n, p) in enumerate([(1.2, 5), (2.3, 7), (0.5, -10), (4.5, -15)], 1)))
    take = lambda o: [r[0] for r in o.select("PeriodId").collect()]
    assert take(q.order_by("PeriodId").skip(1).take(2)) == [-10, 5]
    assert take(q.order_by("PeriodId").take(3)) == [-15, -10, 5]
    assert take(q.order_by_descending("PeriodId").take(2).skip(1)) == [5, -10]
    for column in ("PeriodId", "Normalized", "Id"):
        for ordered in (numbers.order_by(column), numbers.order_by_descending(column)):
            whole = [r[0] for r in ordered.select("Id").collect()]
            for n in (0, 1, 3, 5, 6, 9):
                assert [r[0] for r in ordered.skip(n).select("Id").collect()] == whole[n:], (column, n)
    assert take(q.order_by("PeriodId").take(0)) == []
    nulls = [r[0] for r in numbers.order_by("Normalized").select("Id").collect()]
    assert nulls == [6, 2, 3, 4, 1, 5]
    assert [r[0] for r in numbers.order_by_descending("Normalized").select("Id").collect()] == nulls[::-1]
    page, stats = q.where(f.PeriodId > -12).order_by("PeriodId").take(1).select_with_statistics("Id")
    assert page.count() == 1 and stats.total == 3
    ties = make({"Id": 2, "PeriodId": 1}, {"Id": 1, "PeriodId": 1})
    assert [r[0] for r in ties.order_by("PeriodId").select("Id").collect()] == [1, 2]
    assert [r[0] for r in ties.order_by("PeriodId", True).select("Id").collect()] == [2, 1]


def test_groups(make):
    q = make(*({"Id": i, "Normalized": n, "PeriodId": p} for i, (n, p) in enumerate([(1.2, 5), (7.0, 3), (7.0, 3), (5.5, 3)], 1)))
    rows = {r["k"]: r for r in q.group_by("PeriodId").select(k="Key", n=count(), d=count_distinct("Normalized"), s=sum_("Id"), low=min_("Normalized"), high=max_("Normalized"), a=avg("Normalized")).collect()}
    assert rows[3].asDict() == {"k": 3, "n": 3, "d": 2, "s": 9, "low": 5.5, "high": 7.0, "a": 6.5}
    assert q.where(f.Id > 9).group_by("PeriodId").select(k="Key", n=count()).count() == 0
    assert make({"Id": 2**31 - 1}, {"Id": 1}).group_by("PeriodId", compat_int32=True).select(s=sum_("Id")).first()[0] == -(2**31)
    for bad in (lambda: q.group_by("Normalized"), lambda: q.group_by("PeriodId").select(x=max_("NameSearch")), lambda: q.group_by("PeriodId", strict_indexes=True).select(n=count()), lambda: q.group_by("PeriodId").select(n="Median")):
        with pytest.raises(TableError):
            bad()


def test_errors(numbers, spark):
    bad = [
        lambda: numbers.where(lambda f: f.PeriodId % 2 == 0),
        lambda: numbers.where(lambda f: f.PeriodId == f.Id),
        lambda: numbers.where(lambda f: True),
        lambda: numbers.where(lambda f: ~(f.PeriodId == 1)),
        lambda: numbers.where(lambda f: f.PeriodId == 1 and f.Id == 2),
        lambda: numbers.where(f.NameSearch < "a"),
        lambda: numbers.where(f.PeriodId == "a"),
        lambda: numbers.where(f.PeriodId < None),
        lambda: numbers.where(f.Missing == 1),
        lambda: numbers.where(f.Value == float("nan")),
        lambda: numbers.where(f.PeriodId == True),  # noqa: E712
        lambda: numbers.where(f.Data == b"x"),
        lambda: numbers.select(lambda x: x),
        lambda: numbers.select(),
        lambda: numbers.order_by("Missing"),
        lambda: numbers.select_non_atomically("Id", batch_size=0),
        lambda: numbers.collect("Id", max_result_bytes=3),
        lambda: Query.over(spark.createDataFrame([(1,)], "A int")),
    ]
    for make_error in bad:
        with pytest.raises(TableError):
            make_error()


def test_ids_and_steps(numbers):
    found = numbers.where(f.PeriodId > 0).get_ids()
    assert not found.all_ids and numbers.get_ids().all_ids
    assert numbers.last_step() == 0 and numbers.count() == 6
    assert sorted(r["Id"] for r in numbers.select_non_atomically("Id")) == [1, 2, 3, 4, 5, 6]
    assert len(numbers.collect("Id", "NameSearch")) == 6


def test_requests_and_roles(numbers):
    text = commands.dumps([{"do": "where", "condition": (f.PeriodId == 5) | (f.Date == dt.datetime(2020, 1, 1))}, {"do": "getids"}])
    assert [r[0] for r in commands.run(numbers, text, commands.Role.READER).ids.collect()] == [1]
    page, statistics = commands.run(numbers, commands.dumps([{"do": "where", "condition": f.PeriodId < 5}, {"do": "order", "column": "PeriodId"}, {"do": "take", "n": 1}, {"do": "selectstatistics", "columns": ["Id"]}]), commands.Role.READER)
    assert [r[0] for r in page.collect()] == [5] and statistics.total == 4
    timed = commands.run(numbers, commands.dumps([{"do": "searchtimelimited", "column": "NameSearch", "query": "word", "max_ms": 60_000}, {"do": "selectstatistics", "columns": ["Id"]}]), commands.Role.READER)
    assert timed[0].count() == 0 and timed[1].searched_percentile == 100.0
    with pytest.raises(commands.PermissionDenied):
        commands.run(numbers, commands.dumps([{"do": "delete", "ids": [1]}]), commands.Role.READER)
    with pytest.raises(TableError):
        commands.run(numbers, commands.dumps([{"do": "explode"}]))


def test_plan_pushes_filters_and_prunes(spark, tmp_path, numbers):
    numbers.frame.write.parquet(str(tmp_path / "t"))
    q = Query.over(spark.read.parquet(str(tmp_path / "t"))).between("Normalized", 0, 1).where(f.PeriodId == 3)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = q.select("Id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(Normalized" in plan and "EqualTo(PeriodId,3)" in plan
    assert "NameSearch" not in plan.split("ReadSchema")[-1]


rows_of = st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.sampled_from(["", "a", "A", "b c"]))), max_size=8)
leaf = st.tuples(st.sampled_from(["==", "!=", "<", "<=", ">", ">="]), st.integers(-3, 3))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_of, leaf, leaf, st.booleans(), st.sampled_from(["a", "", None, "B c"]), st.booleans())
def test_against_a_list_model(make, rows, one, two, tie, text, equal):
    import operator

    ops = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

    def holds(op, v, x):
        return (v != x if op == "!=" else v == x if op == "==" else v is not None and ops[op](v, x))

    low = lambda s: (s or None) and s.lower()
    q = make(*({"Id": i, "ObjectId": v, "NameSearch": s} for i, (v, s) in enumerate(rows, 1)))
    q = q.where(commands.decode_node([one[0], "ObjectId", one[1]]))
    q = (q.or_() if tie else q).where(commands.decode_node([two[0], "ObjectId", two[1]])).where(f.NameSearch == text if equal else f.NameSearch != text)
    want = []
    for i, (v, s) in enumerate(rows, 1):
        a, b = holds(*one[:1], v, one[1]), holds(*two[:1], v, two[1])
        if ((a or b) if tie else (a and b)) and (low(s) == low(text)) == equal:
            want.append(i)
    assert ids(q) == want
