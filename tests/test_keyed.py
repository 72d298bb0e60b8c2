"""The keyed table: growth by splits, versions, broken and concurrent writes, cost of a write."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.sources import keyed
from waymark.sources.keyed import ConcurrentWrite, KeyedTable, addressed, parent

SCHEMA = "k long, s string, v long"


def made(spark, tmp_path, **more):
    return KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL(SCHEMA), ["k", "s"], **more)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_buckets_split_so_that_each_row_stays_or_goes_to_the_new_one(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    before = None
    for n in range(1, 20):
        now = [r[0] for r in df.select(addressed(F.col("h"), n)).collect()]
        assert set(now) == set(range(n))
        if before is not None:
            moved = {(a, b) for a, b in zip(before, now, strict=True) if a != b}
            assert moved == {(parent(n - 1, n - 1), n - 1)}
        before = now


def test_upserts_equal_a_dictionary_while_the_table_grows(spark, tmp_path):
    rng, table, wanted = random.Random(5), made(spark, tmp_path, bucket_rows=25), {}
    for step in range(6):
        data = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), rng.randrange(1000)) for _ in range(40)]
        table.upsert(rows(spark, data), [F.desc("v")])
        for key in {d[:2] for d in data}:
            wanted[key] = max(d[2] for d in data if d[:2] == key)
        assert got(table.read()) == sorted([(*k, v) for k, v in wanted.items()], key=str), step
    state = table.state()
    assert state["n"] >= len(wanted) // 25 and max(e["rows"] for e in state["buckets"].values()) < 100


def test_inserts_keep_what_is_there(spark, tmp_path):
    rng, table, wanted = random.Random(6), made(spark, tmp_path, bucket_rows=30), {}
    for _ in range(11):
        data = [(rng.randrange(50), "a", rng.randrange(1000)) for _ in range(15)]
        for _ in range(2):
            table.insert(rows(spark, data), [F.col("v")])
        for d in sorted(data, key=lambda d: d[2]):
            wanted.setdefault(d[:2], d[2])
    assert got(table.read()) == sorted([(*k, v) for k, v in wanted.items()], key=str)
    assert max(len(e["folders"]) for e in table.state()["buckets"].values()) <= keyed.MOST_FOLDERS


def test_versions_broken_writes_and_restart(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path)
    first = table.upsert(rows(spark, [(1, "a", 1), (2, "a", 2)]), [F.col("v")])
    old = table.read()
    with monkeypatch.context() as m:  # the rows are written, the version is not
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.upsert(rows(spark, [(1, "a", 9), (3, "a", 3)]), [F.col("v")])
    again = made(spark, tmp_path)
    assert got(again.read()) == [(1, "a", 1), (2, "a", 2)]
    again.upsert(rows(spark, [(1, "a", 9), (3, "a", 3)]), [F.col("v")])
    assert got(again.read()) == [(1, "a", 9), (2, "a", 2), (3, "a", 3)]
    assert got(old) == got(again.read(first)) == [(1, "a", 1), (2, "a", 2)]
    assert again.vacuum(keep=2) == 1  # what the broken write left
    assert got(again.read(first)) == [(1, "a", 1), (2, "a", 2)]
    assert again.vacuum(keep=1) == 1
    assert got(again.read()) == [(1, "a", 9), (2, "a", 2), (3, "a", 3)]
    with pytest.raises(ValueError):
        again.read(77)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = made(spark, tmp_path), made(spark, tmp_path)
    stale = two.state()
    one.upsert(rows(spark, [(1, "a", 1)]), [F.col("v")])
    two.state = lambda version=None: stale
    with pytest.raises(ConcurrentWrite):
        two.upsert(rows(spark, [(2, "a", 2)]), [F.col("v")])
    assert got(made(spark, tmp_path).read()) == [(1, "a", 1)]


def test_a_write_costs_the_same_while_the_table_grows_tenfold(spark, tmp_path):
    table = made(spark, tmp_path, bucket_rows=1000)
    written = []
    for size in (20_000, 200_000):
        table.upsert(spark.range(size).selectExpr("id AS k", "'a' AS s", "id AS v"), [F.col("v")])
        before = table.state()["buckets"]
        table.upsert(rows(spark, [(7, "a", -1), (8, "a", -1)]), [F.col("v")])
        after = table.state()["buckets"]
        written.append(sum(e["rows"] for b, e in after.items() if before.get(b) != e))
    assert table.state()["n"] >= 200 and max(written) < 5000
    assert table.read().count() == 200_000 and table.read().where("v = -1").count() == 2


def test_empty_tables_and_batches(spark, tmp_path):
    table = made(spark, tmp_path)
    assert got(table.read()) == [] and table.vacuum() == 0
    assert table.upsert(rows(spark, []), [F.col("v")]) == table.insert(rows(spark, []), [F.col("v")]) == 0


def shuffled(spark, action):
    """Records that ``action`` writes to shuffles, over all its stages."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    action()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_a_write_deals_each_row_once(spark, tmp_path):
    table, size = made(spark, tmp_path, bucket_rows=5000), 40_000
    new = spark.range(size).selectExpr("id AS k", "'a' AS s", "id AS v")
    table.upsert(new, [F.col("v")])
    few = 1000  # records that are no rows: counts by task and bucket
    # the old and the new rows once, and the hashes of the new ones
    assert shuffled(spark, lambda: table.upsert(new, [F.desc("v")])) <= 3 * size + few
    assert shuffled(spark, lambda: table.insert(new, [F.col("v")])) <= 3 * size + few
    other = KeyedTable(spark, str(tmp_path / "other"), StructType.fromDDL(SCHEMA), ["k", "s"], bucket_rows=5000)
    assert shuffled(spark, lambda: other.insert(new, [F.col("v")])) <= 2 * size + few
    assert got(other.read()) == got(table.read()) and other.state()["n"] == 8


def test_inserts_into_buckets_that_split_or_were_empty(spark, tmp_path):
    table = made(spark, tmp_path, bucket_rows=10)
    table.insert(rows(spark, [(k, "a", k) for k in range(35)]), [F.col("v")])
    version = table.insert(rows(spark, [(k, "a", -k) for k in range(20, 300)] + [(299, "a", -1000)]), [F.col("v")])
    assert table.insert(rows(spark, [(k, "a", 7) for k in range(300)]), [F.col("v")]) == version
    assert got(table.read()) == got(rows(spark, [(k, "a", k if k < 35 else -1000 if k == 299 else -k) for k in range(300)]))
    assert table.state()["n"] == 30 and sum(e["rows"] for e in table.state()["buckets"].values()) == 300


def test_no_hash_is_dealt_and_no_row_of_a_split(spark, tmp_path):
    table, few = made(spark, tmp_path, bucket_rows=5000), 1000
    new = spark.range(120_000).selectExpr("id AS k", "'a' AS s", "id AS v")
    assert shuffled(spark, lambda: table.insert(new.where("k < 40000"), [F.col("v")])) <= 40_000 + few
    # the keys of the table and the new rows; all eight buckets split
    assert shuffled(spark, lambda: table.insert(new.where("k >= 40000"), [F.col("v")])) <= 120_000 + few
    assert table.state()["n"] == 24 and set(table.state()["buckets"]) == set(range(24))
    assert got(table.read()) == got(new)
    assert shuffled(spark, lambda: table.upsert(new, [F.desc("v")])) <= 240_000 + few
