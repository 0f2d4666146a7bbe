"""SQLite files as a data source: ranges, columns, filters, one state."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tamarack.sources import databases, sessions


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "s.db")
    base = sqlite3.connect(path)
    base.execute("CREATE TABLE sessions (id TEXT PRIMARY KEY, cwd TEXT, user_id TEXT, title TEXT, custom_title TEXT, status TEXT, created_at INTEGER, updated_at INTEGER, last_activity_at INTEGER, deleted_at INTEGER, session_settings TEXT)")
    base.executemany("INSERT INTO sessions VALUES (?, '/p', ?, ?, NULL, ?, ?, 0, ?, ?, NULL)", [(f"s{k}", "u1" if k % 3 else "u2", f"title {k}", "Archived" if k % 5 == 0 else None, k * 1000, k * 1000, 1 if k % 7 == 0 else None) for k in range(1000)])
    base.execute("CREATE TABLE odd (k INTEGER, v TEXT, b BLOB, \"a b\" REAL)")
    base.executemany("INSERT INTO odd VALUES (?, ?, ?, ?)", [(1, "x", b"y", 1.5), ("no number", 7, "text", 2), (None, None, None, None), (-5, "10", b"", -1.0)])
    base.execute("DELETE FROM sessions WHERE created_at BETWEEN 300000 AND 500000")
    base.execute("CREATE TABLE bare (a TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    base.execute("INSERT INTO bare VALUES ('q', 3)")
    base.execute("CREATE TABLE none (a TEXT)")
    base.commit()
    base.close()
    return path


def test_ranges_hold_each_row_once(spark, file):
    rows = databases.table(spark, file, "sessions", rows=100)
    assert rows.rdd.getNumPartitions() > 5
    assert sorted(r.id for r in rows.collect()) == sorted(f"s{k}" for k in range(1000) if not 300 <= k <= 500)
    assert [tuple(r) for r in databases.table(spark, file, "bare").collect()] == [("q", 3)] and databases.table(spark, file, "none").count() == 0
    assert databases.table(spark, file, "sessions").count() == 799


def test_values_of_other_types(spark, file):
    got = sorted((tuple(r) for r in databases.table(spark, file, "odd").collect()), key=str)
    assert got == sorted([(1, "x", b"y", 1.5), (None, "7", None, 2.0), (None, None, None, None), (-5, "10", b"", -1.0)], key=str)


def test_columns_and_filters_reach_the_file(spark, file):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not, StringStartsWith
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    reader = databases._Pushed(file, "sessions", StructType([StructField("id", StringType()), StructField("created_at", LongType())]), 100)
    given = [GreaterThan(("created_at",), 900_000), StringStartsWith(("id",), "s99"), IsNotNull(("id",)), In(("created_at",), (995_000, 3)), Not(EqualTo(("id",), "x"))]
    assert list(reader.pushFilters(given)) == given and len(reader.where) == 4
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("s995", 995_000)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = databases.table(spark, file, "sessions", "id string, created_at bigint").where("created_at >= 990000 AND id <> 's991'")
        assert some.columns == ["id", "created_at"] and some.count() == 9
        odd = databases.table(spark, file, "odd")
        assert {r.v for r in odd.where("v >= '10'").collect()} == {"x", "10", "7"} and odd.where("k IS NULL").count() == 2 and odd.where("v = '7'").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_file_that_changes_is_not_read_half(spark, file):
    reader = databases._Reader(file, "bare", databases.table(spark, file, "bare").schema, 100)
    parts = reader.partitions()
    assert [r for p in parts for r in reader.read(p)] == [("q", 3)]
    base = sqlite3.connect(file)
    base.execute("INSERT INTO bare VALUES ('r', 4)")
    base.commit()
    base.close()
    with pytest.raises(RuntimeError, match="changed"):
        list(reader.read(parts[0]))
    base = sqlite3.connect(file)
    base.execute("PRAGMA journal_mode=WAL")
    base.execute("INSERT INTO bare VALUES ('s', 5)")
    base.commit()
    assert databases.table(spark, file, "bare").count() == 3  # what stands in the log is read, too
    base.close()


def test_sessions_come_straight_from_the_file(spark, file):
    rows = databases.table(spark, file, "sessions", rows=100)
    snapshot = '{"primary": {"version": 1, "uid": "u1", "nickname": "n", "type": "t", "savedAt": 1706745599999}}'
    account = sessions.account(spark.createDataFrame([(snapshot,)], "value string"), 1706745600)
    known = spark.createDataFrame([], "topic_id string")
    got = {r.topic_id for r in sessions.sessions(rows, account, known).select("topic_id").collect()}
    assert got == {f"s{k}" for k in range(1000) if k % 3 and k % 7 and not 300 <= k <= 500}
    with pytest.raises(Exception, match="no table"):
        databases.table(spark, file, "missing").count()
