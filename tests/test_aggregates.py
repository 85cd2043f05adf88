"""Aggregates that take back, windows without copies, lookups on stored keys, and plans."""

import datetime as dt
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cardwatch.functions import aggregates
from cardwatch.functions.aggregates import Aggregate
from cardwatch.operators import windows
from cardwatch.plans import batch, inputs
from cardwatch.sources import bank, tables


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_five_steps_of_an_own_aggregate(spark):
    spread = batch.SPREAD
    data = [("a", float(n), n) for n in range(10)] + [("b", None, 0), ("b", 3.5, 1)]
    frame = spark.createDataFrame(data, "k string, amount double, n0 int")
    whole = aggregates.fold(frame, ["k"], spread)
    halves = aggregates.fold(frame.where("n0 % 2 = 0"), ["k"], spread).unionByName(aggregates.fold(frame.where("n0 % 2 = 1"), ["k"], spread))
    assert sorted(map(tuple, aggregates.merge(halves, ["k"], spread).collect())) == sorted(map(tuple, whole.collect()))
    part = aggregates.fold(frame.where("n0 < 4"), ["k"], spread)
    rest = aggregates.fold(frame.where("n0 >= 4"), ["k"], spread)
    left = {r.k: tuple(r) for r in aggregates.without(whole, part, ["k"], spread).collect()}
    assert left["a"] == tuple(rest.where("k = 'a'").first())
    assert left["b"][1] == 0  # nothing left is the empty state
    empty = spark.range(1).select(*spread.create()).first()
    assert tuple(left["b"][1:]) == tuple(empty)
    said = {r.k: r.said for r in whole.select("k", spread.finished("said")).collect()}
    assert said["a"].spread == pytest.approx(math.sqrt(8.25)) and said["b"].spread == 0


def test_boolean_aggregates_as_states(spark):
    rows = spark.createDataFrame([("a", "1", True), ("a", "2", False), ("b", "3", True), ("c", None, False)], "k string, item_id string, passed boolean")
    for aggregate, expected in ((aggregates.ALL_TRUE, {"a": False, "b": True, "c": True}), (aggregates.ANY_TRUE, {"a": True, "b": True, "c": False})):
        states = aggregates.fold(rows, ["k"], aggregate)
        assert {r.k: r.said for r in states.select("k", aggregate.finished("said")).collect()} == expected
    passed = aggregates.fold(rows.where("item_id = '2'"), ["k"], aggregates.ALL_TRUE)
    left = aggregates.without(aggregates.fold(rows, ["k"], aggregates.ALL_TRUE), passed, ["k"], aggregates.ALL_TRUE)
    assert {r.k: r.s for r in left.select("k", aggregates.ALL_TRUE.finished("s")).collect()} == {"a": True, "b": True, "c": True}


@pytest.mark.parametrize("reach,block", [(3, 8), (20, 50), (1, 4)])
def test_sliding_states_equal_brute_force(spark, reach, block):
    chance = random.Random(reach)
    total = Aggregate({"n": "1", "total": aggregates.exact("amount")}, "total")
    payments = [("m" + str(chance.randrange(3)), chance.randrange(200), round(chance.random() * 1e6, 2)) for _ in range(150)]
    frame = spark.createDataFrame(payments, "m string, slice long, amount double")
    states = windows.sliding_states(aggregates.fold(frame, ["m", "slice"], total), "m", total, reach, block)
    found = {(r.m, r.end_slice): (r.n, float(r.total)) for r in states.collect()}
    expected = {}
    for m, s, amount in payments:
        for end in range(s + 1, s + reach + 1):
            n, so_far = expected.get((m, end), (0, 0.0))
            expected[m, end] = (n + 1, so_far + amount)
    assert set(found) == set(expected) and len(found) == states.count()
    assert all(found[k][0] == expected[k][0] and found[k][1] == pytest.approx(expected[k][1], abs=1e-6) for k in found)


def test_windows_forget_what_left_them(spark):
    """A very large amount leaves no trace in later windows, as doubles would."""
    total = Aggregate({"total": aggregates.exact("amount")}, "total")
    frame = spark.createDataFrame([("m", 0, 1e15), ("m", 5, 0.1), ("m", 6, 0.2)], "m string, slice long, amount double")
    states = windows.sliding_states(aggregates.fold(frame, ["m", "slice"], total), "m", total, reach=5, block=100)
    assert {r.end_slice: float(r.total) for r in states.collect()}[11] == pytest.approx(0.2, abs=1e-12)


def test_sliding_average_makes_no_row_per_window(spark, sf):
    """One exchange behind the slices, and the rows of a window are made last."""
    text = plan(windows.sliding_average(windows.merchant_slices(bank.transactions(spark, sf))))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.index("sequence(") < text.index("Window")  # printed from the top


def test_average_changes_compare_runs_of_windows(spark, sf):
    """The windows themselves, twenty a slice, are neither made nor sorted nor shuffled."""
    text = plan(batch.average_changes(spark, sf))
    assert "sequence(" not in text
    by_block = re.findall(r"Exchange hashpartitioning\(merchant_id#\d+, block#\d+L", text)
    assert len(by_block) == 2  # the same exchange, read for the rows and for the days carried


def test_average_changes_are_those_of_all_windows(spark):
    """Gaps, midnights, changes at one place, amounts unknown and merchants without a stored average."""
    chance, day = random.Random(7), windows.SLICES_PER_DAY
    slices = {(m, base + chance.randrange(60)): (chance.choice([None, 10.0, 10.0, 11.5, 90.0]), 2)
              for m in ("a", "b", "c") for base in (0, day - 30, 3 * day, 3 * day + 500) for _ in range(25)}
    slices[("a", 700)] = slices[("a", 720)] = (30.0, 3)  # one enters as the other leaves
    frame = spark.createDataFrame([(m, s, t, 0 if t is None else n) for (m, s), (t, n) in slices.items()], "merchant_id string, slice long, total double, n long")
    stored = spark.createDataFrame([("a", 10.0), ("b", None)], "id string, avg_txn_amount double")
    everything, runs = windows.sliding_average(frame), windows.average_runs(frame)
    found = sorted(map(tuple, windows.average_changes(runs, stored).collect()))
    assert found == sorted(map(tuple, windows.average_changes(everything, stored).collect()))
    assert {m for m, *_ in found} == {"a", "b"} and len(found) > 20

    last = {"a": 10.0}
    expected = []
    for m, end, average in sorted((r.merchant_id, r.window_end_s, r.avg_amount) for r in everything.collect()):
        before = last.get(m)
        if m != "c" and average is not None and before is not None and round(abs(average - before), 9) > 1:
            expected.append((m, end, before, average))
        last[m] = average if average is not None else {"a": 10.0}.get(m)
    assert found == expected
    assert runs.count() < everything.count() / 2


# --- lookups ----------------------------------------------------------------------

def test_account_lookup_reaches_both_scans(spark, sf):
    text = plan(batch.running_all_true_of_account(spark, sf))
    assert "EqualTo(user_id,42)" in text and "EqualTo(c_custkey,42)" in text


@pytest.mark.parametrize("text,number", [("0000000042", 42), ("42", None), ("00000000042", None), ("12345678901", 12345678901), ("x", None), ("", None), ("9" * 30, None), ("000000004²", None)])
def test_only_a_padded_number_is_looked_up(text, number):
    assert bank.stored_number(text, 10) == number


def test_unknown_ids_find_nothing(spark, sf):
    assert bank.account(spark, sf, "42").count() == 0
    assert bank.transactions_of(spark, sf, "not a number").count() == 0


def test_row_groups_are_skipped(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("user_id"), F.col("id").cast("string").alias("text"))
    tables.save_for_lookups(rows, f"{tmp_path}/t", "user_id", row_group_bytes=64 * 1024)
    found = spark.read.parquet(f"{tmp_path}/t").where("user_id = 4242")
    assert found.count() == 1
    found.collect()
    scans = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = scans.head().metrics().apply("numOutputRows").value()
    assert read < 50_000


# --- plans ------------------------------------------------------------------------

def reads(frame, table):
    return optimized(frame).count(f"{table}.parquet") or sum(table in line for line in plan(frame).split("\n") if "FileScan" in line)


@pytest.mark.parametrize("name,md5,scans", [
    ("payment_rate", 0, 2), ("ruleset_counters", 2, 1), ("dashboard_panel", 2, 2), ("idle_retention", 2, 2),
])
def test_rules_are_evaluated_once(spark, sf, name, md5, scans):
    frame = batch.QUERIES[name](spark, sf)
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("md5(") == md5
    assert plan(frame).count("value:double") + plan(frame).count("ReadSchema: struct<ts:timestamp_ntz>") <= scans + 1
