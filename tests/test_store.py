"""Managed tables: changes, evolution, transactions, indexes, shards and queues."""

import dataclasses
import datetime as dt

import pytest

from tallgrass.errors import TableError
from tallgrass.operators import count
from tallgrass.plans import commands
from tallgrass.plans.predicate import Fields
from tallgrass.sources import Entity, ShardedTable, Store
from tallgrass.streaming import Queue, QueueFull

f = Fields()
COUNTER = Entity("Counter", {"Id": "int", "Name": "string", "Value": "int"})
DATA = Entity("Data", {"Id": "int", "X": "double", "When": "datetime", "Blob": "binary"})


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), bucket_ids=10)


def values(t, *columns):
    return sorted(tuple(r) for r in t.query().select(*(columns or t.entity.columns)).collect())


def test_ids(store):
    t = store.table(COUNTER)
    assert t.save_batch([{"Id": 0, "Name": "a", "Value": 1}, {"Id": 7, "Name": "b", "Value": 2}, {"Id": 0, "Name": "c", "Value": 3}, {"Id": 7, "Name": "late", "Value": 9}]) == [1, 7, 8, 7]
    assert values(t) == [(1, "a", 1), (7, "b", 2), (8, "c", 3)]
    t.delete(8)
    assert t.save({"Id": 0, "Name": "d", "Value": 4}) == 9 and t.query().last_step() == 0
    assert t.save_batch([]) == [] and t.save_batch(None) == []
    for bad in ({"Id": -1}, {"Id": 2**30 + 5}):
        with pytest.raises(TableError):
            t.save(bad)


def test_upsert_update_delete(store):
    t = store.table(COUNTER)
    t.save_batch([{"Id": i, "Name": str(i), "Value": i} for i in range(1, 31)])
    t.save({"Id": 3, "Name": "three", "Value": -3})
    t.update("Value", {4: 44, 29: 290, 500: 1})
    t.update("Name", 5, "")
    t.delete({1, 2, 30, 77})
    got = {r[0]: r[1:] for r in values(t.store.table(COUNTER), "Id") or []}
    rows = {r["Id"]: r for r in t.query().select_entity().collect()}
    assert len(got) == 27 and rows[3]["Name"] == "three" and rows[4]["Value"] == 44 and rows[29]["Value"] == 290 and rows[5]["Name"] is None
    for bad in (lambda: t.update("Value", 4, "x"), lambda: t.update("Value", 4, 1.5), lambda: t.update("Id", 4, 1), lambda: t.update_non_atomically("Value", {1: 1}, 0), lambda: t.delete_non_atomically([1], -1)):
        with pytest.raises(TableError):
            bad()


def test_values(store):
    t = store.table(DATA)
    t.save({"Id": 1, "X": -0.0, "When": dt.datetime(2020, 1, 2, 3, 4, 5, 678_999), "Blob": b""})
    row = t.query().select_entity().first()
    assert str(row["X"]) == "-0.0" and row["When"] == dt.datetime(2020, 1, 2, 3, 4, 5, 678_000) and row["Blob"] is None
    assert t.where(f.Blob == None).count() == 1  # noqa: E711
    for bad in (float("nan"), float("inf")):
        with pytest.raises(TableError):
            t.save({"Id": 2, "X": bad})
    with pytest.raises(TableError):
        t.save({"Id": 2, "Blob": b"x" * 1_048_577})


def test_types():
    @dataclasses.dataclass
    class Good:
        Id: int
        Name: str | None
        Odd: list
        When: dt.datetime | None = None

    assert Entity.of(Good) == Entity("Good", {"Id": "int", "Name": "string", "When": "datetime"})

    @dataclasses.dataclass
    class Flag:
        Id: int
        On: bool

    for bad in (Flag, ("NoId", {"A": "int"}), ("F", {"Id": "int", "x": "float"})):
        with pytest.raises(TableError):
            Entity.of(bad)
    with pytest.raises(TableError):
        Entity.of(("L", {"Id": "long"}), strict_types=True)


def test_evolution(store):
    old, wide = Entity("T", {"Id": "int", "A": "int"}), Entity("T", {"Id": "int", "A": "int", "B": "int", "S": "string"})
    store.table(old).save_batch([{"Id": 1, "A": 1}, {"Id": 2, "A": 2}])
    t = store.table(wide)
    assert [tuple(r) for r in t.query().select_entity().orderBy("Id").collect()] == [(1, 1, 0, None), (2, 2, 0, None)]
    assert t.where(f.B == 0).count() == 0 and t.where(f.B != 5).count() == 0
    t.save({"Id": 3, "A": 3, "B": None, "S": "x"})
    assert [tuple(r) for r in t.where(f.B == None).select("Id", "B").collect()] == [(3, None)]  # noqa: E711
    t.update("B", 1, 7)
    assert t.where(f.B == 7).count() == 1
    store.table(old).save({"Id": 3, "A": 33})  # the other columns stay
    assert [tuple(r) for r in t.where(f.Id == 3).select_entity().collect()] == [(3, 33, None, "x")]
    with pytest.raises(TableError):
        store.table(("T", {"Id": "int", "A": "string"}))
    assert store.table_definition("T") == "public class T { public int Id { get; set; } public int? A { get; set; } public int? B { get; set; } public string S { get; set; }  } "
    assert store.table_definition("none") is None and store.tables() == ["T"]
    with pytest.raises(TableError, match="gaps"):
        t.create_property_index("B")


def test_increment(store):
    t, new = store.table(COUNTER), {"Id": 0, "Name": "test", "Value": 2**31 - 1}
    assert t.atomic_increment("Value", 1, new, t.where(f.Name == "test")) is None
    assert t.atomic_increment("Value", 1, new, t.where(f.Name == "TEST")) == 2**31 - 1
    assert values(t, "Value") == [(-(2**31),)]
    assert t.atomic_increment("Value", 1, new, t.where(f.Name == "test"), only_if_old_equal=5) == -(2**31)
    assert values(t, "Value") == [(-(2**31),)]
    t.save({"Id": 0, "Name": "test", "Value": 0})
    for bad in (lambda: t.atomic_increment("Value", 1, new, t.where(f.Name == "test")), lambda: t.atomic_increment("Id", 1, new), lambda: t.atomic_increment("Name", 1, new), lambda: t.atomic_increment("Value", 1, None)):
        with pytest.raises(TableError):
            bad()


def test_transactions(store, spark):
    t = store.table(COUNTER)
    t.save_batch([{"Id": 1, "Name": "a", "Value": 1}, {"Id": 2, "Name": "b", "Value": 2}])
    version = store.manifest.data["version"]
    with store.transaction() as tran:
        c = store.table(COUNTER, tran)
        c.update("Value", 1, 10)
        c.update("Name", 1, "z")
        c.delete(2)
        assert c.save({"Id": 0, "Name": "n", "Value": 3}) == 3 and c.save({"Id": 0, "Name": "m", "Value": 4}) == 4
        store.table(DATA, tran).save({"Id": 1, "X": 1.0})
        assert values(t) == [(1, "a", 1), (2, "b", 2)]
        tran.commit()
    assert values(t) == [(1, "z", 10), (3, "n", 3), (4, "m", 4)] and store.table(DATA).count() == 1
    assert store.manifest.data["version"] == version + 1
    store.transaction().commit()
    tran = store.transaction()
    c = store.table(COUNTER, tran)
    c.update("Value", 1, 5)
    for bad in (lambda: c.update("Value", 1, 6), lambda: c.delete(1), lambda: c.save({"Id": 1}), lambda: c.save_non_atomically([]), lambda: c.atomic_increment("Value", 1, {})):
        with pytest.raises(TableError):
            bad()
    with store.transaction() as dropped:
        store.table(COUNTER, dropped).delete(1)
    assert t.count() == 3


def test_readers_keep_their_version_and_replicas(store, spark, tmp_path):
    t = store.table(COUNTER)
    t.save_batch([{"Id": i, "Name": "x", "Value": i} for i in range(1, 25)])
    before = t.query()
    store.replicate(str(tmp_path / "copy"))
    t.delete(range(1, 20))
    assert before.count() == 24 and t.count() == 5
    assert Store(spark, str(tmp_path / "copy")).table(COUNTER).count() == 24
    assert Store(spark, str(tmp_path / "store")).table(COUNTER).count() == 5
    with pytest.raises(TableError):
        store.replicate(str(tmp_path / "copy"))
    assert store.status()["is_up"]


def test_two_handles(store, spark, tmp_path):
    t, other = store.table(COUNTER), Store(spark, str(tmp_path / "store"), bucket_ids=10).table(COUNTER)
    row = lambda i: {"Id": i, "Name": "x", "Value": i}
    t.save(row(1))
    other.save(row(2))
    assert t.save(row(0)) == 3 and values(other, "Id") == values(t, "Id") == [(1,), (2,), (3,)]
    data = store.manifest.copy()
    other.delete(1)
    with pytest.raises(TableError, match="has changed"):
        store.manifest.save(data)
    store.refresh()
    store.files.claim(f"{store.files.root}/manifest-{store.manifest.data['version'] + 1}.claim")  # another writer is at it
    with pytest.raises(TableError, match="another writer"):
        t.save(row(9))


def test_a_change_reads_its_rows_once(store, spark):
    """Rows that a plan makes anew at each run, and rows of one id in their order."""
    t = store.table(COUNTER)
    noise = spark.range(40).selectExpr("CAST(1 + floor(rand() * 1000) AS INT) AS Id", "'n' AS Name", "CAST(id AS INT) AS Value")
    t.save_batch(noise)
    assert t.count() == t.query().select("Id").distinct().count() > 30
    t.delete(range(1, 1002))
    t.save_batch(spark.range(100).coalesce(1).selectExpr("1 AS Id", "CAST(id AS STRING) AS Name", "CAST(id AS INT) AS Value"))
    assert values(t) == [(1, "0", 0)]


def test_indexes(store, spark, tmp_path):
    t = store.table(COUNTER)
    t.save_batch([{"Id": 1, "Name": "a", "Value": 1}, {"Id": 2, "Name": "b", "Value": 1}])
    t.create_group_index("Value", "Id")
    t.create_property_index("Value")
    assert store.existing_indexes() == ["Counter Id", "Counter Value", "Counter Value Id"]
    assert t.group_by("Value", strict_indexes=True).select(k="Key", n=count()).first()["n"] == 2
    with pytest.raises(TableError, match="null"):
        t.save({"Id": 3, "Value": None})
    t.save({"Id": 3, "Name": "c", "Value": 4})
    assert t.where(f.Value == 4).count() == 1
    assert Store(spark, str(tmp_path / "store"), delete_indexes=False).existing_indexes() == ["Counter Id", "Counter Value", "Counter Value Id"]
    t.remove_property_index("Value")
    assert store.existing_indexes() == ["Counter Id", "Counter Value Id"]
    t.remove_group_index("Value", "Id")
    assert store.existing_indexes() == []
    for bad in (lambda: t.create_property_index("Name"), lambda: t.create_group_index("Name", "Value")):
        with pytest.raises(TableError):
            bad()


def test_frames(store, spark):
    t = store.table(COUNTER)
    t.save_batch(spark.createDataFrame([(1, "a", 1), (2, "", 2), (15, "c", 3)], "Id int, Name string, Value int"))
    t.update("Value", spark.createDataFrame([(2, 22), (99, 1)], "i int, v int"))
    t.delete(spark.createDataFrame([(15,)], "i int"))
    assert [tuple(r) for r in t.query().select_entity().orderBy("Id").collect()] == [(1, "a", 1), (2, None, 22)]
    with pytest.raises(TableError):
        t.save_batch(spark.createDataFrame([(None, "a", 1)], "Id int, Name string, Value int"))


def test_shards(store):
    shops = ShardedTable(store, Entity("Shop", {"Id": "int", "Sid": "int", "G": "int"}), [1, 2])
    keys = shops.save_batch([{"Id": 0, "Sid": 0, "G": g} for g in (5, 5, 6, 5)])
    assert [s for s, _ in keys] == [1, 2, 1, 2] and shops.count() == 4
    assert {r["k"]: r["n"] for r in shops.group_by("G").select(k="Key", n=count()).collect()} == {5: 3, 6: 1}
    assert sorted(tuple(r) for r in shops.per_shard("G").select(k="Key", n=count()).collect()) == [(1, 5, 1), (1, 6, 1), (2, 5, 2)]
    shops.update("G", {keys[0]: 9, (2, keys[2][1]): 77})
    shops.delete([keys[1]])
    assert sorted(r[0] for r in shops.select("G").collect()) == [5, 6, 9]
    shops.create_group_index("G", "Sid")
    assert shops.existing_indexes() == ["Shop G Sid", "Shop Id"] and shops.tables() == ["Shop"]
    assert {r["Sid"] for r in shops.on_shards(2).select("Sid").collect()} == {2}
    for bad in (lambda: shops.on_shards(3), lambda: shops.save_batch([{"Id": 1, "Sid": 99}]), lambda: shops.save({"Id": 1, "Sid": 0}), lambda: shops.save_batch([{"Id": 0, "Sid": 0}, {"Id": 1, "Sid": 1}])):
        with pytest.raises(TableError):
            bad()


def test_queue(spark):
    q = Queue()
    with pytest.raises(QueueFull):
        for i in range(500):
            q.put((i, [i]))
    assert len(q) == 299
    df = q.drain(spark, "a int, b array<int>")
    assert df.count() == 299 and len(q) == 0 and q.get_all() == []


def test_requests_change_tables(store):
    t = store.table(COUNTER)
    run = lambda *c, role=commands.Role.ADMIN: commands.run(t, commands.dumps(list(c)), role)
    assert run({"do": "save", "items": [{"Id": 0, "Name": "a", "Value": 1}]}, role=commands.Role.WRITER) == [1]
    run({"do": "update", "column": "Value", "values": {1: 5}})
    assert run({"do": "where", "condition": f.Value == 5}, {"do": "count"}) == 1
    assert run({"do": "where", "condition": f.Id == 1}, {"do": "increment", "column": "Value", "by": 2, "new_item": {"Id": 0}}) == 5
    run({"do": "delete", "ids": [1]})
    assert run({"do": "count"}) == 0
    with pytest.raises(commands.PermissionDenied):
        run({"do": "propertyindex", "column": "Value"}, role=commands.Role.WRITER)
