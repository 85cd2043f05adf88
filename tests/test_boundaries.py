"""Hand-written boundary rows."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cardwatch.functions import aggregates, draws, scalars
from cardwatch.operators import metrics, verdicts, waterfall, windows
from cardwatch.operators.rules import (
    Registry,
    Rule,
    RuleSet,
    credit_rules,
    default_registry,
    location_rules,
    merchant_rules,
    worst_risk,
)

MERCHANT = "struct<id: string, reputation: int, avg_txn_amount: double>"
ACCOUNT = "struct<balance: double, credit_limit: double>"


def values(frame, column):
    return [row[column] for row in frame.collect()]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("average, amount, risk", [
    (50.0, 40.0, "LOW"), (50.0, 60.0, "LOW"), (50.0, 30.0, "MEDIUM"), (50.0, 70.0, "MEDIUM"),
    (50.0, 29.99, "HIGH"), (50.0, 70.01, "HIGH"),
    (14.0, 16.0, "LOW"), (14.0, 16.01, "MEDIUM"), (14.0, 18.01, "HIGH"),
    (4.0, 4.0, "LOW"), (4.0, 4.01, "HIGH"),
    (-14.0, -16.0, "LOW"), (None, 4.0, None), (4.0, None, None), (float("nan"), 1.0, "HIGH"),
])
def test_amount_risk(spark, average, amount, risk):
    frame = spark.createDataFrame([(average, amount)], "average double, amount double")
    found = frame.select(F.expr(scalars.amount_risk("amount", "average")).alias("risk"))
    # A negative average has a negative deviation, so its bands are empty.
    expected = "HIGH" if average is not None and average < 0 else risk
    assert values(found, "risk") == [expected]


def test_reputation_risk(spark):
    frame = spark.createDataFrame([(n,) for n in (0, 3, 4, 7, 8, 10, 11)], "r int")
    found = frame.select(F.expr(scalars.reputation_risk("r")).alias("risk"))
    assert values(found, "risk") == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "MEDIUM"]


@pytest.mark.parametrize("risks, expected", [
    (("LOW", "LOW"), "LOW"), (("MEDIUM", "LOW"), "MEDIUM"), (("MEDIUM", "MEDIUM"), "HIGH"),
    (("HIGH", "LOW"), "HIGH"), ((None, "MEDIUM"), "MEDIUM"), ((None, None), "LOW"),
])
def test_worst_risk(spark, risks, expected):
    frame = spark.createDataFrame([risks], "a string, b string")
    assert values(frame.select(F.expr(worst_risk(["a", "b"])).alias("r")), "r") == [expected]


def test_location_sum_limit_is_inclusive(spark):
    rule_set = RuleSet(
        "sums", (Rule("given", "total"),), "double", lambda r: r[0], location_rules().rejects
    )
    frame = spark.createDataFrame([("a", 1.0), ("b", 1.000001)], "id string, total double")
    rows = verdicts.evaluate(frame, Registry([rule_set])).select("verdict_0.outcome")
    assert values(rows, "outcome") == ["RejectedForFraud", "Approved"]


def test_unknown_merchant_is_approved(spark):
    frame = spark.createDataFrame(
        [("a", 5.0, None), ("b", 5.0, ("m", 5, 5.0))], f"id string, amount double, merchant {MERCHANT}"
    )
    rows = verdicts.evaluate(frame, Registry([merchant_rules()]))
    found = rows.select("verdict_0.result_risk", "verdict_0.outcome", "verdict_0.reason").collect()
    assert [tuple(r) for r in found] == [("LOW", "Approved", "No explanation")] * 2


def test_credit_limit_is_inclusive(spark):
    frame = spark.createDataFrame(
        [("a", 100.0, (900.0, 1000.0)), ("b", 100.01, (900.0, 1000.0)), ("c", 1.0, None)],
        f"id string, amount double, account {ACCOUNT}",
    )
    registry = Registry([credit_rules()])
    judged = verdicts.with_final(verdicts.evaluate(frame, registry), registry)
    # Without an account there is no result, so no verdict either.
    assert values(judged, "final_status") == ["Approved", "RejectedForCredit", "Pending"]
    assert values(frame.select(waterfall.credit_passed().alias("ok")), "ok") == [True, False, None]


def test_waterfall_skips_credit_for_fraud(spark):
    merchants = spark.createDataFrame([("m", 5, 50.0)], "id string, reputation int, avg_txn_amount double")
    accounts = spark.createDataFrame(
        [("rich", 0.0, 1000.0), ("poor", 990.0, 1000.0)],
        "acct_number string, balance double, credit_limit double",
    )
    txns = spark.createDataFrame(
        [("1", "poor", "m", 500.0), ("2", "poor", "m", 65.0), ("3", "rich", "m", 50.0),
         ("4", "rich", "x", 50.0), ("5", "none", "m", 50.0)],
        "id string, acct_number string, merchant_id string, amount double",
    )
    rows = waterfall.waterfall(txns, merchants, accounts).orderBy("id").collect()
    assert [(r.fraud_result, r.payment_result, r.final_status, r.error) for r in rows] == [
        (90, None, "RejectedForFraud", None),
        (50, False, "RejectedForCredit", None),
        (5, True, "Approved", None),
        (None, None, "Pending", "Merchant must be set"),
        (5, None, "Pending", "Account must be set"),
    ]


def test_merchant_groups(spark):
    ids = ["0", "1", "9", "10", "20", "21", "x", None]
    frame = spark.createDataFrame([(i,) for i in ids], "merchant_id string")
    row = frame.agg(*metrics.merchant_group_columns(F.col("merchant_id"))).first()
    assert (row.n_amazon, row.n_walmart) == (2, 2)


def two_sets():
    always = lambda name: RuleSet(
        name, (Rule("r", "bad"),), "boolean", lambda r: r[0], "{result}", reason=f"{name} says no"
    )
    return Registry([always("first"), always("second")])


def test_double_reject_counts_two_events_and_one_transaction(spark):
    frame = spark.createDataFrame([("a", True), ("b", False)], "id string, bad boolean")
    registry = two_sets()
    judged = verdicts.with_final(verdicts.evaluate(frame, registry), registry)
    counts = judged.agg(*verdicts.counter_columns(registry)).first()
    assert (counts.rejected_fraud_events, counts.rejected_txns, counts.approved) == (2, 1, 1)
    row = judged.where("id = 'a'").first()
    assert row.rejecting_ruleset == "FraudRules:first"
    assert row.rejecting_reason == "first says no"
    assert row.rejecting_rulesets == ["FraudRules:first", "FraudRules:second"]


def test_no_applicable_set_stays_pending(spark):
    from dataclasses import replace

    registry = two_sets()
    for name in ("first", "second"):
        registry.update(replace(registry.get(name), selects="not bad"))
    frame = spark.createDataFrame([("a", True)], "id string, bad boolean")
    judged = verdicts.with_final(verdicts.evaluate(frame, registry), registry)
    row = judged.first()
    assert (row.n_applicable, row.final_status) == (0, "Pending")
    assert judged.agg(*verdicts.counter_columns(registry)).first().completions == 0
    assert verdicts.route(frame, registry).count() == 0


def test_everything_waits_while_all_sets_are_off(spark):
    registry = two_sets()
    registry.disable("first")
    registry.disable("second")
    frame = spark.createDataFrame([("a", True)], "id string, bad boolean")
    judged = verdicts.with_final(verdicts.evaluate(frame, registry), registry)
    row = judged.first()
    assert (row.n_applicable, row.final_status, row.n_rejecting) == (0, "Pending", 0)
    counts = judged.agg(*verdicts.counter_columns(registry)).first()
    assert (counts.completions, counts.rejected_fraud_events) == (0, 0)


POSTED = "item_id string, ordinal int, ruleset string, n_applicable int, outcome string, posted_ms long"


def test_duplicate_results_count_once_and_newest_wins(spark):
    postings = spark.createDataFrame([
        ("a", 0, "x", 2, "Approved", 10),
        ("a", 0, "x", 2, "RejectedForFraud", 20),
        ("a", 1, "y", 2, "Approved", 15),
        ("b", 0, "x", 2, "Approved", 10),
        ("b", 0, "x", 2, "Approved", 11),
    ], POSTED)
    for rows in (
        verdicts.assemble_outcomes(postings, ["x", "y"]),
        verdicts.assemble(postings, ["x", "y"], ["outcome"], ["posted_ms"]),
    ):
        found = {r.item_id: r for r in rows.collect()}
        newest = found["a"].results["x"]
        assert (newest if isinstance(newest, str) else newest.outcome) == "RejectedForFraud"
        assert (found["a"].n_posted, found["b"].n_posted) == (2, 1)
        assert [r.item_id for r in verdicts.complete(rows).collect()] == ["a"]
    lists = {r.item_id: r for r in verdicts.result_lists(postings, ["x", "y"]).collect()}
    assert lists["b"].n_results == 2
    assert [(e.ruleset, e.outcome, e.copies) for e in lists["b"].results] == [("x", "Approved", 2)]
    first = {r.item_id: r for r in verdicts.first_outcomes(postings).collect()}
    assert (first["a"].n_received, first["a"].first_outcome) == (2, "Approved")


def test_unlisted_sets_and_outcomes_are_kept(spark):
    postings = spark.createDataFrame([
        ("a", 0, "x", 3, "Approved", 10), ("a", 70, "late set", 3, "Approved", 9), ("a", 1, "y", 3, "NeedsReview", 11),
        ("b", 64, "x", 2, "RejectedForFraud", 10), ("b", 0, "y", 2, "Approved", 11),
    ], POSTED)
    found = {r.item_id: r for r in verdicts.assemble_outcomes(postings, ["x", "y"]).collect()}
    assert found["a"].results == {"x": "Approved", "y": "Other", "late set": "Approved"}
    named = verdicts.assemble_outcomes(postings, ["x", "y"], outcomes=("Approved", "NeedsReview")).collect()
    assert {r.item_id: r.results["y"] for r in named} == {"a": "NeedsReview", "b": "Approved"}
    lists = {r.item_id: r for r in verdicts.result_lists(postings, ["x", "y"]).collect()}
    assert {i: r.n_results for i, r in lists.items()} == {"a": 3, "b": 2}
    assert sorted(tuple(e) for e in lists["a"].results) == [("late set", "Approved", 1), ("x", "Approved", 1), ("y", "NeedsReview", 1)]
    first = {r.item_id: (r.n_received, r.first_outcome) for r in verdicts.first_outcomes(postings).collect()}
    assert first == {"a": (3, "Approved"), "b": (2, "RejectedForFraud")}


def test_two_unlisted_sets_complete_an_item(spark):
    postings = spark.createDataFrame([
        ("a", 8, "one", 2, "Approved", 10), ("a", 9, "two", 2, "RejectedForFraud", 11), ("a", 9, "two", 2, "Approved", 12),
        ("b", 8, "one", 2, "Approved", 10), ("b", 8, "one", 2, "Approved", 13),
    ], POSTED)
    for rows in (
        verdicts.assemble_outcomes(postings, ["x"]), verdicts.assemble(postings, ["x"], ["outcome", "posted_ms"], ["posted_ms"]),
    ):
        found = {r.item_id: r for r in rows.collect()}
        assert set(found["a"].results) == {"one", "two"} and (found["a"].n_posted, found["b"].n_posted) == (2, 1)
        assert [r.item_id for r in verdicts.complete(rows).collect()] == ["a"]
    assert found["a"].results["two"].outcome == "Approved" and found["b"].results["one"].posted_ms == 13


def test_sets_without_rules_or_results(spark):
    frame = spark.createDataFrame([("1", 5.0)], "id string, amount double")
    for rule_set, outcome in ((location_rules(), "RejectedForFraud"), (merchant_rules(), "Approved"), (credit_rules(), "Approved")):
        off = replace(rule_set, rules=tuple(replace(r, enabled=False) for r in rule_set.rules))
        registry = Registry([off])
        judged = verdicts.with_final(verdicts.evaluate(frame, registry), registry)
        assert values(judged, "final_status") == [outcome]
    nameless = spark.createDataFrame([(None, 5.0)], "id string, amount double")
    registry = Registry([location_rules()])
    assert values(verdicts.with_final(verdicts.evaluate(nameless, registry), registry), "final_status") == ["Pending"]


def test_texts_with_quotes_and_braces_are_plain_text(spark):
    rule_set = RuleSet("Own", (Rule("r", "'{x}'"),), kind="risk", roll_up=worst_risk, rejects="{result} = 'LOW'", reject_status="It's {off}")
    registry = Registry([rule_set])
    frame = spark.createDataFrame([("1",)], "id string")
    assert values(verdicts.with_final(verdicts.evaluate(frame, registry), registry), "final_status") == ["It's {off}"]


def test_sums_are_compared_unrounded(spark):
    rule_set = replace(location_rules(), rules=(Rule("r", "amount"),), shared={})
    registry = Registry([rule_set])
    frame = spark.createDataFrame([("1", 1.0000004), ("2", 1.0)], "id string, amount double")
    assert values(verdicts.with_final(verdicts.evaluate(frame, registry), registry), "final_status") == ["Approved", "RejectedForFraud"]


@pytest.mark.parametrize("results, everything, anything", [
    ([], True, False), ([True, True], True, True), ([True, False], False, True), ([False], False, False),
])
def test_all_and_any_true(spark, results, everything, anything):
    frame = spark.createDataFrame(
        [("i", r) for r in results] + [(None, False), (None, True)], "item string, ok boolean"
    )
    row = frame.agg(
        aggregates.all_true(F.col("ok"), F.col("item")).alias("every"),
        aggregates.any_true(F.col("ok"), F.col("item")).alias("some"),
    ).first()
    assert (row.every, row.some) == (everything, anything)


def test_running_all_true(spark):
    frame = spark.createDataFrame(
        [("k", n, ok) for n, ok in enumerate([True, True, False, True])], "k string, n int, ok boolean"
    )
    rows = verdicts.running_all_true(frame, "k", "n", "ok").orderBy("n")
    assert values(rows, "all_true_so_far") == [True, True, False, False]


def test_latency_excludes_clock_errors(spark):
    frame = spark.createDataFrame(
        [(10, 12, 15), (10, 4, 5)], "t_routed long, t_executor long, t_aggregator long"
    )
    timed = metrics.stage_latencies(frame)
    assert values(timed, "latency_ms") == [5, None]
    assert values(timed, "clock_error") == [False, True]
    row = metrics.latency_summary(timed).first()
    assert (row.total_latency_ms, row.latency_items, row.whole_avg_latency_ms) == (5, 1, 5)


def test_empty_input_summaries(spark):
    none = spark.createDataFrame([], "t_routed long, t_executor long, t_aggregator long")
    row = metrics.latency_summary(metrics.stage_latencies(none)).first()
    assert (row.total_latency_ms, row.latency_items, row.avg_latency_ms) == (0, 0, None)


def test_texts(spark):
    one = spark.range(1)
    row = one.select(
        scalars.throughput_text(F.lit(95), 30).alias("tps"),
        scalars.elapsed_text(F.lit(3_723_004)).alias("elapsed"),
        scalars.result_message(F.lit(None).cast("boolean")).alias("none"),
        scalars.result_message(F.lit(True)).alias("yes"),
        scalars.metric_line(F.lit("a.b"), F.lit(1.5), F.lit(7)).alias("line"),
        scalars.reject_metric_name(F.lit("FraudRules:Merchant Rules")).alias("metric"),
        scalars.padded_id(F.lit(123), 2).alias("long_id"),
        scalars.padded_id(F.lit(7), 3).alias("short_id"),
        scalars.enum_name(F.lit(9)).alias("no_status"),
        scalars.reason_or_default(F.lit(None).cast("string")).alias("reason"),
    ).first()
    assert row.tps == "3 TPS" and row.elapsed == "01:02:03.004"
    assert (row.none, row.yes) == ("Not evaluated", "evaluated to: true")
    assert row.line == "a.b 1.5 7 "
    assert row.metric == "bib.rejectedby.FraudRules_Merchant_Rules"
    assert (row.long_id, row.short_id, row.no_status) == ("123", "007", None)
    assert row.reason == "No explanation"


def test_near_cities(spark):
    pairs = [("Paris", "Paris"), ("Paris", "London"), ("Paris", "Sofia"), ("Paris", "Nowhere"),
             ("Nowhere", "Nowhere"), (None, "Paris")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    near = frame.select(scalars.is_near(F.col("a"), F.col("b")).alias("near"))
    assert values(near, "near") == [True, True, False, False, False, False]


def test_quoted_names_survive(spark):
    rule_set = RuleSet("it's", (Rule("r", "bad"),), "boolean", lambda r: r[0], "{result}", reason="can't \\ won't")
    frame = spark.createDataFrame([("a", True)], "id string, bad boolean")
    row = verdicts.evaluate(frame, Registry([rule_set])).select("verdict_0.*").first()
    assert (row.ruleset, row.reason) == ("FraudRules:it's", "can't \\ won't")


def test_draws_are_repeatable_and_shaped(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    g = ids.select(F.expr(draws.standard_normal("id")).alias("g"), F.expr(draws.percent_true("id", 10)).alias("hit"))
    row = g.agg(F.avg("g").alias("m"), F.stddev("g").alias("s"), F.avg(F.col("hit").cast("int")).alias("p")).first()
    assert abs(row.m) < 0.03 and abs(row.s - 1) < 0.03 and abs(row.p - 0.1) < 0.01
    shared = verdicts.evaluate(ids, Registry([location_rules()])).agg(
        F.avg((F.col("verdict_0.outcome") != "Approved").cast("int"))).first()[0]
    assert abs(shared - 0.048) < 0.01


@pytest.mark.parametrize("now, expected_end, expected", [(1, None, None), (20, 100, 30.0), (21, 105, 40.0), (41, 205, 40.0), (60, 205, 40.0)])
def test_current_average(spark, now, expected_end, expected):
    """Slices 1 and 20: window end, in seconds, and average seen at different times."""
    slices = spark.createDataFrame([("m", 1, 30.0, 1), ("m", 20, 50.0, 1)], "merchant_id string, slice long, total double, n long")
    rows = windows.current_average(slices, F.lit(now)).collect()
    if expected is None:
        assert rows == []
        return
    direct = windows.sliding_average(slices).where(F.col("window_end_s") <= now * 5).orderBy(F.desc("window_end_s")).first()
    assert (rows[0].window_end_s, rows[0].avg_amount) == (direct.window_end_s, direct.avg_amount)


def test_sliding_average_across_days(spark):
    """A slice just before midnight counts in the windows after it."""
    day = windows.SLICES_PER_DAY
    slices = spark.createDataFrame(
        [("m", day - 1, 10.0, 1), ("m", day + 3, 30.0, 1), ("m", 5 * day, 7.0, 1)],
        "merchant_id string, slice long, total double, n long",
    )
    found = {r.window_end_s // 5: (r.avg_amount, r.n_txns) for r in windows.sliding_average(slices).collect()}
    assert len(found) == 24 + 20
    assert found[day] == (10.0, 1) and found[day + 3] == (10.0, 1)
    assert found[day + 4] == (20.0, 2) and found[day + 19] == (20.0, 2)
    assert found[day + 20] == (30.0, 1)
    live = {r.slice: r.live_average for r in windows.average_before(slices).collect()}
    assert live == {day - 1: None, day + 3: 10.0, 5 * day: 30.0}


def test_bands(spark):
    frame = spark.createDataFrame([(0.1,), (0.2,), (0.49,), (0.5,), (None,)], "v double")
    found = frame.select(metrics.band("bib.fraud.rate", F.col("v")).alias("c"))
    assert values(found, "c") == ["green", "amber", "amber", "red", None]
    found = frame.select(metrics.band("bib.payment.rate", F.col("v") * 2000).alias("c"))
    assert values(found, "c") == ["red", "red", "amber", "green", None]


def test_registry(spark):
    registry = default_registry()
    assert [s.qualified_name for _, s in registry.active()] == [
        "FraudRules:LocationBasedRules", "FraudRules:Merchant Rules"]
    registry.disable("Merchant Rules")
    assert [n for n, _ in registry.active()] == [0]
    registry.enable("Merchant Rules")
    registry.update(registry.get("Merchant Rules").add(Rule("extra", "'LOW'")))
    rows = registry.to_df(spark)
    assert rows.count() == 7
    assert rows.where("rule = 'extra'").first().qualified_rule == "FraudRules:Merchant Rulesextra"
    assert [s.name for s in registry.by_category("FraudRules")] == ["LocationBasedRules", "Merchant Rules"]
    registry.delete("LocationBasedRules")
    for missing in (lambda: registry.get("LocationBasedRules"), lambda: registry.delete("nope"),
                    lambda: registry.update(credit_rules())):
        with pytest.raises(KeyError):
            missing()
    with pytest.raises(ValueError):
        registry.add(merchant_rules())
