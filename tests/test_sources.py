"""Typed sources, writers by instrument, and tables that are written together."""

import datetime as dt

import pytest

from crossloom.operators.upserts import merge_domains
from crossloom.sources import typed
from crossloom.sources.versioned import Conflict, Store
from crossloom.streaming import upsert_store


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_missing_paths_and_columns(spark, tmp_path):
    for kind in typed.KINDS:
        for path in (None, [], str(tmp_path / "none.csv")):
            df = typed.read_kind(spark, kind, path)
            assert df.schema == typed.schema_of(kind) and df.count() == 0
    (tmp_path / "m.csv").write_text('name,extra,is_st,instrument,listing_date\n"a, ""b""\nc",1,true,SH600000,2020-01-02\n,2,odd,SZ000001,never\n')
    (tmp_path / "empty.csv").write_text("")
    got = rows(typed.read_kind(spark, "security_master", str(tmp_path)), "instrument")
    assert got[0][:2] == ("SH600000", 'a, "b"\nc') and got[0][6:8] == (True, dt.date(2020, 1, 2)) and got[0][2] is None
    assert got[1][:2] == ("SZ000001", None) and got[1][6:8] == (None, None)


def test_nested_folders_with_different_headers(spark, tmp_path):
    a, b = tmp_path / "one" / "deep", tmp_path / "two"
    a.mkdir(parents=True)
    b.mkdir()
    (a / "x.csv").write_text("symbol,open,date,close\nX,1,2024-01-01,10\nX,1,2024-01-02,11\n")
    (tmp_path / "one" / "y.csv").write_text("date,symbol,close\n2024-01-01,Y,bad\n")
    (b / "x.csv").write_text("close,date,symbol\n12,2024-01-02,X\n")
    (b / "other.csv").write_text("date,close\n2024-01-01,5\n")
    (b / "notes.txt").write_text("symbol,date,close\nZ,2024-01-01,1\n")
    got = rows(typed.read_closes(spark, [str(tmp_path / "one"), str(b), str(tmp_path / "no")]), "instrument", "trade_date")
    assert got == [("X", dt.date(2024, 1, 1), 10.0), ("X", dt.date(2024, 1, 2), 12.0), ("Y", dt.date(2024, 1, 1), None)]
    named = typed.read_kind(spark, "closes", [str(tmp_path / "one"), str(b)], file="at").select("instrument", "at").distinct().collect()
    assert {(r[0], r["at"].rpartition("/")[2]) for r in named} == {("X", "x.csv"), ("Y", "y.csv")}


def test_folders_by_instrument(spark, tmp_path):
    path = str(tmp_path / "bars")
    typed.write_by_instrument(spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "instrument string, close int, more string"), path, ["close", "volume"])
    typed.write_by_instrument(spark.createDataFrame([("B", 3), ("B", 4)], "instrument string, close int"), path, ["close", "volume"])
    df = typed.read_by_instrument(spark, path, "close int, volume double")
    assert rows(df, "instrument", "close") == [(1, None, "A"), (3, None, "B"), (4, None, "B")]
    plan = df.where("instrument = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(instrument" in plan
    assert df.where("instrument = 'A'").inputFiles() and all("instrument=A" in f for f in df.where("instrument = 'A'").select("*").inputFiles()) or "PartitionFilters" in plan


def failing(spark):
    """A table whose second partition can't be written."""
    from pyspark.sql import functions as F

    return spark.range(0, 10, 1, 2).select("id", F.when(F.col("id") < 9, "ok").otherwise(F.raise_error(F.lit("lost"))).alias("v"))


def test_a_failed_write_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no table"):
        store.read("a")
    assert store.read("a", schema="id long").count() == 0
    assert store.publish({"a": spark.range(3), "b": spark.range(5)}) == 1
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": spark.range(100), "b": failing(spark)})
    assert (store.read("a").count(), store.read("b").count(), store.versions()) == (3, 5, [1])
    with pytest.raises(Exception, match="lost"):
        merge_domains(store, {"a": (spark.range(7), ["id"]), "b": (failing(spark), ["id"])})
    assert (store.read("a").count(), store.read("b").count()) == (3, 5)
    version = merge_domains(store, {"a": (spark.range(2, 7), ["id"])}, {"c": (spark.range(1), ["id"])})
    assert (store.read("a").count(), store.read("b").count(), store.tables()) == (7, 5, ["a", "b", "c"])
    assert (store.read("a", 1).count(), store.tables(1)) == (3, ["a", "b"])
    gone = store.vacuum(keep=1)
    assert store.versions() == [version] and len(gone) == 4
    assert (store.read("a").count(), store.read("b").count()) == (7, 5)


def test_an_upsert_touches_its_parts_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.upsert({"t": (spark.range(1000).selectExpr("id AS k", "'old' AS v"), ["k"])})
    before = store.manifest()["tables"]["t"]["folders"]
    new = spark.createDataFrame([(5, "new", 1.5), (2000, "new", None)], "k long, v string, w double")
    store.upsert({"t": (new, ["k"])})
    after = store.manifest()["tables"]["t"]["folders"]
    assert len(before) == 64 and sum(before[p] != after[p] for p in before) <= 2
    got = store.read("t")
    assert got.count() == 1001 and rows(got.where("v = 'new'"), "k") == [(5, "new", 1.5), (2000, "new", None)]
    assert len(store.vacuum(keep=1)) <= 2 and store.read("t").count() == 1001


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.publish({"a": spark.range(1)})
    base, version = store.manifest(), store._begin()
    store.publish({"a": spark.range(2)})
    with pytest.raises(Conflict):
        store._commit(version, base, {})
    assert store.read("a").count() == 2


def test_a_ledger_takes_a_batch_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("r1", "review", 0.5, "x")], "run_id string, status string, primary_metric double, other string")
    typed.append_ledger(store, df, "monday")
    version = typed.append_ledger(store, df, "monday")
    typed.append_ledger(store, df.selectExpr("'r2' AS run_id", "status"), "tuesday")
    got = store.read("ledger")
    assert version == 1 and tuple(got.columns) == typed.KINDS["ledger"]
    assert rows(got.select("run_id", "status", "primary_metric"), "run_id") == [("r1", "review", "0.5"), ("r2", "review", None)]


def test_a_stream_into_a_store(spark, tmp_path):
    df = spark.createDataFrame([(k, v) for k in range(50) for v in (1, 2)], "k long, v long")
    df.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for again in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        upsert_store(stream, store, "t", ["k"], str(tmp_path / f"c{again}")).awaitTermination(120)
        assert rows(store.read("t").selectExpr("count(*) AS n", "sum(v) AS s"), "n") == [(50, 100)]
