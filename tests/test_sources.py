import datetime as dt

import pytest
from pyspark.sql import functions as F

from cardwatch import session
from cardwatch.operators import retention
from cardwatch.sources import bank, replay, schemas, sinks, tables
from cardwatch.streaming import flows


def test_formats_read_back(spark, sf, tmp_path):
    accounts = bank.accounts(spark, sf)
    for fmt in ("parquet", "orc", "json", "csv"):
        path = f"{tmp_path}/{fmt}"
        tables.append(accounts, path, fmt)
        back = tables.scan(spark, path, schemas.ACCOUNT, fmt)
        assert back.exceptAll(accounts).count() == 0 and back.count() == accounts.count()
    tables.append(accounts, f"{tmp_path}/parquet")
    assert tables.scan(spark, f"{tmp_path}/parquet").count() == 2 * accounts.count()


def test_derived_tables_fit_their_schemas(spark, sf):
    def shape(frame):
        return [(f.name, f.dataType) for f in frame.schema.fields]

    assert shape(bank.accounts(spark, sf)) == [(f.name, f.dataType) for f in schemas.ACCOUNT.fields]
    assert shape(bank.merchants(spark, sf)) == [(f.name, f.dataType) for f in schemas.MERCHANT.fields]
    txns = bank.transactions(spark, sf).drop("event_type")
    assert shape(txns) == [(f.name, f.dataType) for f in schemas.TRANSACTION.fields]


def test_given_schemas_match_the_files(spark, sf):
    for name, text in schemas.GIVEN.items():
        assert spark.read.parquet(f"{sf}/{name}.parquet").dtypes == spark.read.schema(text).parquet(
            f"{sf}/{name}.parquet").dtypes


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:x", "account", user="u")
    assert plain == {"url": "jdbc:x", "dbtable": "account", "fetchsize": "10000", "user": "u"}
    split = tables.jdbc_options("jdbc:x", "t", split_column="id", bounds=(0, 99), splits=4)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "id", "0", "99", "4")
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "t", split_column="id")


def test_point_lookup_reaches_the_scan(spark, sf, tmp_path):
    bank.accounts(spark, sf).write.parquet(f"{tmp_path}/a")
    found = tables.lookup_one(tables.scan(spark, f"{tmp_path}/a", schemas.ACCOUNT), "acct_number", "0000000001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(acct_number,0000000001)" in plan
    assert found.count() == 1


@pytest.mark.parametrize("size, requested", [(3, 7), (3, 2), (3, 3), (1, 4)])
def test_replay_wraps(spark, size, requested):
    stored = spark.range(size).select(
        F.lpad(F.col("id").cast("string"), 14, "0").alias("id"), F.col("id").alias("payload"))
    wanted = [(f"{n:014d}", n % size) for n in range(requested)]
    mapped = replay.cyclic(stored, F.lit(requested), F.lit(size))
    joined = replay.cyclic_by_number(spark, stored, requested, size)
    for rows in (mapped, joined):
        assert sorted((r.id, r.payload) for r in rows.collect()) == wanted


def test_outcomes_are_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Approved"), ("b", "RejectedForFraud"), ("c", "Approved")], "id string, final_status string")
    sinks.write_outcomes(rows, f"{tmp_path}/o")
    approved = sinks.read_outcome(spark, f"{tmp_path}/o", "Approved")
    rejected = sinks.read_outcome(spark, f"{tmp_path}/o", "RejectedForFraud")
    assert "PartitionFilters: [isnotnull(final_status" in approved._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in approved.collect()) == ["a", "c"]
    assert sorted(r.id for r in sinks.history(approved, rejected).collect()) == ["a", "b", "c"]


def test_versions_upsert_and_repeat(spark, tmp_path):
    path = f"{tmp_path}/v"
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    second = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    sinks.write_version(first, path, 0)
    sinks.write_version(second, path, 1)
    sinks.write_version(second, path, 1)  # a batch given twice
    assert sorted(tuple(r) for r in sinks.read_newest(spark, path, "k").collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_folded_versions_bound_what_is_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    writer = flows.versions(path, "k", fold_every=3)
    for batch_id in [0, 1, 2, 2, 3, 4, 5, 6, 6]:
        rows = [("same", batch_id), (f"k{batch_id}", batch_id)]
        writer(spark.createDataFrame(rows, "k string, v int").coalesce(1), batch_id)
    found = {r.k: r.v for r in sinks.read_newest(spark, path, "k").collect()}
    assert found == {"same": 6} | {f"k{n}": n for n in range(7)}
    assert sinks._unfolded(spark, path) == (5, [6])
    read = sinks.read_newest(spark, path, "k").inputFiles()
    assert not any(f"batch_id={n}/" in f for n in range(6) for f in read)


def test_errors(spark):
    rows = spark.createDataFrame([("x", 1, 5), ("x", 2, -1), ("y", 3, None), ("y", 4, 7)], "c string, n int, v int")
    checked = sinks.with_error(rows, {"missing": F.col("v").isNull(), "negative": F.col("v") < 0})
    assert [r.error for r in checked.orderBy("n").collect()] == [None, "negative", "missing", None]
    log = sinks.last_errors(checked, F.col("c"), F.col("n")).collect()
    assert sorted(tuple(r) for r in log) == [("x", "negative", 1), ("y", "missing", 1)]


@pytest.mark.parametrize("keep", [1, 5, 59, 60, 61, 500])
def test_newest_keeps_exactly(spark, keep):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(n, start + dt.timedelta(minutes=7 * (n // 2))) for n in range(300)], "n int, ts timestamp")
    kept = [r.n for r in retention.newest(rows, keep, "ts", F.desc("n")).collect()]
    assert kept == sorted(range(300), reverse=True)[:keep]


def test_not_idle_bound_is_inclusive(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(n, start + dt.timedelta(seconds=n)) for n in (0, 99, 100, 400)], "n int, ts timestamp")
    assert sorted(r.n for r in retention.not_idle(rows, "ts").collect()) == [100, 400]


def test_work_dir_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    one, two = session.work_dir(spark, "x"), session.work_dir(spark, "x")
    assert one != two
    if shared:
        assert one.startswith(shared.rstrip("/"))
