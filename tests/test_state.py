"""State that streams carry: assembly, cleaned-up tables, event-time scoring, the metric pump, changing rules."""

import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from cardwatch.operators.rules import Registry, Rule, credit_rules, default_registry, location_rules, merchant_rules
from cardwatch.operators import metrics, verdicts
from cardwatch.plans import batch, inputs
from cardwatch.sources import bank, sinks
from cardwatch.streaming import flows, runs
from cardwatch.streaming.assembly import Assembly
from cardwatch.streaming.changing import RuleTable, judged_by_time, verdict_writer
from cardwatch.streaming.cleanup import PendingItems
from cardwatch.streaming.ordered import OrderedScoring
from cardwatch.streaming.pump import MetricPump
from cardwatch.streaming.stages import StagedFlow

START = dt.datetime(2024, 1, 1)
POSTED = "item_id string, ts timestamp, ordinal int, ruleset string, n_applicable int, outcome string, posted_ms long"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def posting(item, item_s, ruleset, posted_s, outcome="Approved", needed=2):
    ms = int(at(posted_s).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return (item, at(item_s), {"x": 0, "y": 1, "z": 2}.get(ruleset, 9), ruleset, needed, outcome, ms)


# --- assembly ---------------------------------------------------------------------

SCENARIO = [
    posting("a", 0, "x", 1), posting("a", 0, "y", 2, "RejectedForFraud"),
    posting("b", 5, "x", 6), posting("c", 8, "x", 9),
    posting("b", 5, "x", 50, "RejectedForFraud"), posting("b", 5, "unlisted", 60),
    posting("b", 5, "x", 70, "Approved"),  # behind the completion
    posting("d", 100, "x", 101, needed=3), posting("d", 100, "y", 102, needed=3), posting("d", 100, "z", 399, needed=3),
    posting("e", 250, "x", 251), posting("a", 0, "x", 260, "RejectedForCredit"),
    posting("f", 400, "x", 401), posting("g", 560, "x", 561), posting("g", 560, "y", 562), posting("h", 800, "x", 801),
]


def run_assembly(spark, path, parts):
    assembly = Assembly(spark, path, ttl_s=300)
    for batch_id, part in enumerate(parts):
        assembly.writer()(spark.createDataFrame(part, POSTED), batch_id)
        reported = {r.item_id for r in assembly.reports().collect()}
        seen = {r[0] for p in parts[: batch_id + 1] for r in p}
        state = assembly.open.after(batch_id).collect()
        assert {r.item_id for r in state} == seen - reported and len(state) == len(seen - reported)
    return assembly


def reported(assembly):
    return rows(assembly.reports().select(
        "item_id", "status", "n_posted", "completed_ms",
        F.transform("results", lambda r: F.concat_ws("=", r["ruleset"], r["result"]["outcome"])),
    ))


@pytest.mark.parametrize("cuts", [[], [3, 9, 12]])
def test_assembly_reports_do_not_depend_on_batches(spark, tmp_path, cuts):
    bounds = [0, *cuts, len(SCENARIO)]
    parts = [SCENARIO[a:b] for a, b in zip(bounds, bounds[1:])]
    assembly = run_assembly(spark, f"{tmp_path}/a", parts)
    found = {r[0]: (r[1], r[2], list(r[4])) for r in reported(assembly)}
    assert found == {
        "a": ("COMPLETE", 2, ["x=Approved", "y=RejectedForFraud"]),
        "b": ("COMPLETE", 2, ["unlisted=Approved", "x=RejectedForFraud"]),
        "c": ("TIMED_OUT", 1, ["x=Approved"]),
        "d": ("COMPLETE", 3, ["x=Approved", "y=Approved", "z=Approved"]),
        "e": ("TIMED_OUT", 1, ["x=Approved"]),
        "f": ("TIMED_OUT", 1, ["x=Approved"]),
        "g": ("COMPLETE", 2, ["x=Approved", "y=Approved"]),
    }
    assert len(reported(assembly)) == 7


def test_assembly_batch_may_be_repeated(spark, tmp_path):
    once, twice = Assembly(spark, f"{tmp_path}/once", 300), Assembly(spark, f"{tmp_path}/twice", 300)
    parts = [SCENARIO[:4], SCENARIO[4:9], SCENARIO[9:]]
    for batch_id, part in enumerate(parts):
        once.writer()(spark.createDataFrame(part, POSTED), batch_id)
        for _ in range(2):
            twice.writer()(spark.createDataFrame(part, POSTED), batch_id)
    assert reported(once) == reported(twice)
    assert rows(once.open.after(2)) == rows(twice.open.after(2))


def test_late_results_are_kept_apart_and_ids_are_let_go(spark, tmp_path):
    assembly = Assembly(spark, f"{tmp_path}/a", ttl_s=300)
    parts = [
        [posting("a", 0, "x", 1), posting("a", 0, "y", 2)], [posting("a", 0, "x", 10, "RejectedForFraud")],
        [posting("b", 1000, "x", 1001)], [posting("c", 3, "x", 4)],
    ]
    ids = []
    for batch_id, part in enumerate(parts):
        assembly.writer()(spark.createDataFrame(part, POSTED), batch_id)
        ids.append(assembly.finished_ids.after(batch_id).count())
    assert [(r[0], r[1]) for r in reported(assembly)] == [("a", "COMPLETE")]
    assert sorted(r.item_id for r in assembly.late().collect()) == ["a", "c"]
    assert ids == [1, 1, 0, 0]
    kept = {name: sorted(os.listdir(f"{tmp_path}/a/{name}")) for name in ("open", "clock", "finished_ids", "items", "posted")}
    assert kept["open"] == kept["clock"] == kept["finished_ids"] == ["batch_id=2", "batch_id=3"]
    assert kept["items"] == kept["posted"] == []


@pytest.fixture(scope="module")
def pieces(spark, sf, tmp_path_factory):
    """The given tables with events as a folder of eight files in time order."""
    folder = tmp_path_factory.mktemp("pieces")
    for name in ("customer", "supplier"):
        shutil.copy(f"{sf}/{name}.parquet", folder)
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").coalesce(1)
    os.mkdir(f"{folder}/events.parquet")
    for part in range(8):
        events.where(F.floor(F.col("event_id") / 125) == part).write.parquet(f"{folder}/part{part}")
        data = [f for f in os.listdir(f"{folder}/part{part}") if f.endswith(".parquet")]
        shutil.copy(f"{folder}/part{part}/{data[0]}", f"{folder}/events.parquet/{part}.parquet")
    return str(folder)


def arrange(folder, order):
    """Let the stream pick the files up in this order."""
    for place, part in enumerate(order):
        when = time.time() - 1000 + place
        os.utime(f"{folder}/events.parquet/{part}.parquet", (when, when))


def stored(spark, folder, per_trigger):
    from cardwatch.plans import streams

    return streams.streamed_transactions(spark, folder, per_trigger)


@pytest.mark.parametrize("per_trigger", [2, 8])
def test_assembly_stream_over_batches(spark, pieces, tmp_path, per_trigger):
    arrange(pieces, range(8))
    judged = inputs.judge(stored(spark, pieces, per_trigger), bank.merchants(spark, pieces), default_registry())
    assembly = Assembly(spark, f"{tmp_path}/a")
    postings = inputs.post(judged, default_registry())
    runs.drain(runs.start_batches(postings, assembly.writer(), f"{tmp_path}/c", mode="append"))
    from cardwatch.plans import streams

    expected = {(r[0], r[1], r[2]) for r in rows(streams.stream_assembly(spark, pieces))}
    assert {(r[0], r[1], r[2]) for r in reported(assembly)} == expected


# --- keyed tables -----------------------------------------------------------------

def test_deletes_hide_keys_until_they_are_written_anew(spark, tmp_path):
    path = f"{tmp_path}/t"

    def write(batch_id, *pairs):
        sinks.write_version(spark.createDataFrame(list(pairs), "k string, v int"), path, batch_id)

    def delete(batch_id, *keys):
        sinks.delete_version(spark.createDataFrame([(k,) for k in keys], "k string"), path, batch_id)

    write(0, ("a", 1), ("b", 1))
    write(1, ("a", 2), ("c", 1))
    delete(1, "a", "zz")
    assert rows(sinks.read_newest(spark, path, "k")) == [("b", 1), ("c", 1)]
    write(2, ("a", 3))
    delete(2, "b")
    delete(2, "b")
    assert rows(sinks.read_newest(spark, path, "k")) == [("a", 3), ("c", 1)]
    sinks.compact(spark, path, ["k"], 2)
    assert rows(sinks.read_newest(spark, path, "k")) == [("a", 3), ("c", 1)]
    write(3, ("b", 9))
    assert rows(sinks.read_newest(spark, path, "k")) == [("a", 3), ("b", 9), ("c", 1)]


def test_lists_append_once_per_batch_and_survive_folds(spark, tmp_path):
    path = f"{tmp_path}/t"

    def write(batch_id, *entries):
        sinks.write_version(spark.createDataFrame(list(entries), "k string, rule string, ok boolean"), path, batch_id)

    def lists():
        return {r.k: [(e.rule, e.ok) for e in r.results] for r in sinks.read_lists(spark, path, ["k"], ["rule"], "results").collect()}

    write(0, ("a", "r1", True), ("b", "r1", False))
    write(1, ("a", "r2", False))
    write(1, ("a", "r2", False))  # a batch given twice
    assert lists() == {"a": [("r1", True), ("r2", False)], "b": [("r1", False)]}
    sinks.compact_entries(spark, path, ["k"], 1)
    write(2, ("a", "r1", True))  # a rule that speaks again appends again
    sinks.delete_version(spark.createDataFrame([("b",)], "k string"), path, 2)
    assert lists() == {"a": [("r1", True), ("r1", True), ("r2", False)]}
    write(3, ("b", "r3", True))
    sinks.compact_entries(spark, path, ["k"], 3)
    assert lists() == {"a": [("r1", True), ("r1", True), ("r2", False)], "b": [("r3", True)]}


def test_vacuum_keeps_what_a_reader_may_need(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    for batch_id in range(9):
        sinks.write_version(one.withColumn("v", F.lit(batch_id)), path, batch_id)
        if batch_id % 3 == 2:
            before = sinks.read_newest(spark, path, "k")
            sinks.compact(spark, path, ["k"], batch_id)
            sinks.vacuum(spark, path, keep=2)
            assert rows(before) == [("a", batch_id)]  # resolved before the fold, read behind the clean-up
    assert rows(sinks.read_newest(spark, path, "k")) == [("a", 8)]
    assert sorted(os.listdir(f"{path}_snapshots")) == ["upto=5", "upto=8"]
    assert sorted(os.listdir(path)) == ["batch_id=6", "batch_id=7", "batch_id=8"]
    assert sinks.vacuum(spark, f"{tmp_path}/none") == []


def test_finished_items_leave_pending_and_results(spark, tmp_path):
    """Fifteen batches of items that finish a batch later: tables and files hold only what waits."""
    items = PendingItems(spark, f"{tmp_path}/p", fold_every=4)
    for n in range(15):
        part = [posting(f"i{n}", n, "x", n)] + ([posting(f"i{n - 1}", n - 1, "y", n)] if n % 7 else [])
        for _ in range(1 + (n % 3 == 0)):  # some batches are given twice
            items.writer()(spark.createDataFrame(part, POSTED), n)
    waiting = {f"i{n - 1}" for n in range(7, 15, 7)} | {"i14"}
    assert {r.item_id for r in items.pending().collect()} == waiting
    assert {r.item_id for r in items.results().collect()} == waiting
    assert {r.item_id for r in items.finished().collect()} == {f"i{n}" for n in range(15)} - waiting
    for path in (items.pending_path, items.results_path):
        assert len(os.listdir(path)) <= 8 and len(os.listdir(f"{path}_snapshots")) == 2
        assert len(os.listdir(f"{path}_deletes")) <= 8


@pytest.mark.parametrize("per_trigger", [2, 4, 8])
def test_credit_lists_over_batches(spark, pieces, tmp_path, per_trigger):
    from cardwatch.operators import waterfall

    arrange(pieces, [3, 1, 0, 2, 7, 5, 6, 4])
    rules = waterfall.running_credit_rules()
    entries = waterfall.credit_entries(
        stored(spark, pieces, per_trigger), bank.accounts(spark, pieces), rules, inputs.rule_names(spark, rules)
    )
    writer = flows.appended(f"{tmp_path}/t", "id", fold_every=2)
    runs.drain(runs.start_batches(entries, writer, f"{tmp_path}/c", mode="append"))
    expected = batch.credit_limit_lists(spark, pieces)
    assert rows(inputs.credit_lists(spark, f"{tmp_path}/t")) == rows(expected)
    assert {r.n_results for r in expected.select("n_results").distinct().collect()} == {1, 2, 3}


@pytest.mark.parametrize("per_trigger", [2, 8])
def test_summed_parts_over_batches(spark, pieces, tmp_path, per_trigger):
    """Files in no order, parts folded and cleaned up on the way, one batch given twice."""
    from cardwatch.operators import windows

    arrange(pieces, [5, 0, 7, 2, 1, 6, 3, 4])
    keys, fields = ["merchant_id", "slice"], ["total", "n"]
    writer = flows.summed(f"{tmp_path}/t", keys, fields, windows.merchant_slices, fold_every=2)

    def twice(rows, batch_id):
        writer(rows, batch_id)
        if batch_id == 1:
            writer(rows, batch_id)

    runs.drain(runs.start_batches(stored(spark, pieces, per_trigger), twice, f"{tmp_path}/c", mode="append"))
    found = windows.sliding_average(sinks.read_summed(spark, f"{tmp_path}/t", keys, fields))
    assert rows(inputs.shown(found, "avg_amount")) == rows(batch.sliding_merchant_avg(spark, pieces))


# --- event time -------------------------------------------------------------------

@pytest.mark.parametrize("order,per_trigger", [([7, 2, 0, 5, 1, 6, 3, 4], 2), ([4, 3, 6, 1, 5, 0, 2, 7], 3)])
def test_event_time_scores_do_not_depend_on_the_order_of_files(spark, pieces, tmp_path, order, per_trigger):
    arrange(pieces, order)
    scoring = OrderedScoring(spark, bank.merchants(spark, pieces), f"{tmp_path}/s", delay_s=60 * 86_400)
    query = runs.drain(runs.start_batches(stored(spark, pieces, per_trigger), scoring.writer(), f"{tmp_path}/c", mode="append"))
    scoring.finish(runs.last_batch(query))
    assert rows(inputs.shown(scoring.verdicts(), "average")) == rows(batch.asof_feedback(spark, pieces))
    assert scoring.late().count() == 0


def test_payments_are_scored_as_time_passes_and_late_ones_kept_apart(spark, pieces, tmp_path):
    arrange(pieces, [0, 1, 2, 3, 4, 5, 7, 6])
    scoring = OrderedScoring(spark, bank.merchants(spark, pieces), f"{tmp_path}/s", delay_s=60)
    query = runs.drain(runs.start_batches(stored(spark, pieces, 1), scoring.writer(), f"{tmp_path}/c", mode="append"))
    last = runs.last_batch(query)
    held = scoring.held.after(last).count()
    assert 0 < held < 125
    scoring.finish(last)
    late = {r.id for r in scoring.late().collect()}
    scored = {r.id: r.risk for r in scoring.verdicts().collect()}
    assert late and late | set(scored) == {r.id for r in bank.transactions(spark, pieces).collect()} and not late & set(scored)
    whole = {r.id: r.risk for r in batch.asof_feedback(spark, pieces).collect()}
    early = [i for i in scored if i < "00000000000750"]
    assert len(early) == 750 and all(scored[i] == whole[i] for i in early)


@pytest.mark.parametrize("order,per_trigger", [(range(8), 3), ([1, 0, 3, 2, 5, 4, 7, 6], 2)])
def test_pump_reads_the_same_whatever_the_batches(spark, pieces, tmp_path, order, per_trigger):
    arrange(pieces, order)
    registry = default_registry()
    judged = inputs.judge(stored(spark, pieces, per_trigger), bank.merchants(spark, pieces), registry)
    timed = metrics.stage_latencies(metrics.with_stage_times(judged, inputs.txn_number()))
    pump = MetricPump(spark, registry, f"{tmp_path}/p", delay_s=60 * 86_400)
    query = runs.drain(runs.start_batches(timed, pump.writer(), f"{tmp_path}/c", mode="append"))
    pump.finish(runs.last_batch(query))
    assert rows(pump.readings().select("tick_s", "name", "value")) == rows(batch.metric_series(spark, pieces))


def test_pump_closes_ticks_carries_totals_and_keeps_late_counts(spark, tmp_path):
    registry = Registry([merchant_rules()])
    pump = MetricPump(spark, registry, f"{tmp_path}/p", delay_s=10)
    schema = "id string, merchant_id string, ts timestamp, amount double, latency_ms long, merchant struct<id:string,avg_txn_amount:double,reputation:short>"

    def batch_of(*seconds):
        made = spark.createDataFrame([(str(s), "00000005", at(s), 1.0, 7, None) for s in seconds], schema)
        return verdicts.with_final(verdicts.evaluate(made, registry), registry)

    for batch_id, seconds in enumerate([(0, 1, 6), (7, 12, 30), (2, 31, 60), (61,)]):
        for _ in range(2):  # a batch given twice
            pump.writer()(batch_of(*seconds), batch_id)
    assert pump.ticks.after(3).count() == 1
    pump.finish(3)
    rates = {r.tick_s % 86_400: r.value for r in pump.readings().where("name = 'bib.payment.rate'").collect()}
    assert rates == {5: 0.4, 10: 0.4, 15: 0.2, 35: 0.4, 65: 0.4}
    everything = {r.tick_s % 86_400: r.value for r in pump.readings().where("name = 'bib.payments.all'").collect()}
    assert everything == {5: 2.0, 10: 4.0, 15: 5.0, 35: 7.0, 65: 9.0}
    assert spark.read.parquet(f"{tmp_path}/p/late").agg(F.sum("latency_items")).first()[0] == 1
    lines = [r.value for r in spark.read.text(f"{tmp_path}/p/lines").collect()]
    assert sum(line.startswith("bib.payments.amazon ") for line in lines) == 5


def test_live_pump_runs_on_its_trigger(spark, sf, tmp_path):
    from cardwatch.plans import streams

    staged = metrics.with_stage_times(streams.streamed_verdicts(spark, sf), inputs.txn_number())
    pump = MetricPump(spark, default_registry(), f"{tmp_path}/p")
    query = pump.start(metrics.stage_latencies(staged))
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not query.recentProgress:
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.recentProgress[0].numInputRows == 1000
    # All but the ticks within the delay are read out.
    assert pump.ticks.after(0).count() <= 2 and pump.readings().where("name = 'bib.payments.all'").count() > 900


# --- rules ------------------------------------------------------------------------

def test_registry_round_trip_gives_equal_verdicts(spark, sf, tmp_path):
    registry = default_registry()
    registry.update(registry.get("Merchant Rules").add(Rule("Large", "if(amount > 50, 'HIGH', 'LOW')", precondition="amount > 1")))
    registry.add(credit_rules(selects="amount >= 25"))
    registry.disable("Credit Rules")
    table = RuleTable(spark, f"{tmp_path}/rules")
    table.save(registry, 0)
    read = table.load(0)
    items = bank.transactions(spark, sf)
    merchants = bank.merchants(spark, sf)
    assert rows(inputs.judge(items, merchants, read).drop("merchant")) == rows(inputs.judge(items, merchants, registry).drop("merchant"))
    read.enable("Credit Rules")
    assert [n for n, _ in read.active()] == [0, 1, 2]
    with pytest.raises(ValueError):
        table.save(registry, 0)


def test_numbers_of_sets_are_fixed(spark):
    registry = default_registry()
    registry.add(credit_rules())
    registry.delete("LocationBasedRules")
    assert [(n, s.name) for n, s in registry.active()] == [(1, "Merchant Rules"), (2, "Credit Rules")]
    registry.add(location_rules())
    assert [n for n, _ in registry.active()] == [1, 2, 3]
    assert [(n, s.name) for n, s in Registry.from_df(registry.to_df(spark)).active()] == [(n, s.name) for n, s in registry.active()]
    with pytest.raises(ValueError):
        Registry([location_rules()]).add(merchant_rules(), number=0)


def test_rules_switched_off_between_batches(spark, sf, tmp_path):
    table = RuleTable(spark, f"{tmp_path}/rules")
    table.save(default_registry(), 0)
    merchants, txns = bank.merchants(spark, sf), bank.transactions(spark, sf)
    halves = [txns.where(F.col("id") < "00000000000500"), txns.where(F.col("id") >= "00000000000500")]
    write = verdict_writer(table, merchants, f"{tmp_path}/out")
    write(halves[0], 0)
    later = default_registry()
    later.disable("LocationBasedRules")
    table.save(later, 1)
    write(halves[0], 0)  # repeated: by the rules it had
    write(halves[1], 1)
    found = {r.id: (r.rules_version, r.final_status) for r in spark.read.parquet(f"{tmp_path}/out/verdicts").collect()}
    whole = {r.id: r.final_status for r in inputs.judged(spark, sf).collect()}
    without = {r.id: r.final_status for r in inputs.judged(spark, sf, later).collect()}
    for i, (version, status) in found.items():
        assert (version, status) == ((0, whole[i]) if i < "00000000000500" else (1, without[i]))
    assert any(whole[i] != without[i] for i in without)


def test_items_before_the_first_rules_stay_pending(spark, sf):
    rows_ = judged_by_time(bank.transactions(spark, sf), bank.merchants(spark, sf), [("2030-01-01 00:00:00", default_registry())])
    assert {(r.rules_version, r.final_status) for r in rows_.collect()} == {(-1, "Pending")}


# --- progress and measured times ----------------------------------------------------

def test_progress_of_a_whole_run(spark, tmp_path):
    os.mkdir(f"{tmp_path}/in")
    one = spark.range(3).coalesce(1)
    one.write.parquet(f"{tmp_path}/one")
    data = [f for f in os.listdir(f"{tmp_path}/one") if f.endswith(".parquet")][0]
    for n in range(110):
        shutil.copy(f"{tmp_path}/one/{data}", f"{tmp_path}/in/{n:03}.parquet")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    watched = stream.observe("seen", F.count(F.lit(1)).alias("n"))
    with runs.ProgressLog(spark, f"{tmp_path}/log") as log:
        query = runs.drain(watched.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    assert len(query.recentProgress) <= 100
    report = runs.pacing_report(log.batches(query), interval_ms=0).first()
    assert (report.batches, report.input_rows) == (110, 330)
    assert log.batches(query).agg(F.sum(F.expr("cast(observed['seen']['n'] as int)"))).first()[0] == 330


def test_stages_are_stamped_in_order(spark, pieces, tmp_path):
    arrange(pieces, range(8))
    flow = StagedFlow(spark, bank.merchants(spark, pieces), default_registry(), f"{tmp_path}/f")
    with runs.ProgressLog(spark, f"{tmp_path}/log") as log:
        for start in (lambda: flow.route(stored(spark, pieces, 4)), flow.execute, flow.aggregate):
            runs.drain(start())
    timed = flow.timed_items()
    assert timed.count() == 1000 and timed.where("clock_error or to_executor_ms < 0 or to_aggregator_ms < 0").count() == 0
    report = {r.stage: r for r in flow.report().collect()}
    assert report["Aggregator"].n_items == 1000 and report["Aggregator"].avg_latency_ms > 0
    observed = log.batches().selectExpr("explode(observed) as (stage, o)").selectExpr("stage", "explode(o) as (name, n)")
    sums = {r.name: r.n for r in observed.groupBy("name").agg(F.sum(F.col("n").cast("int")).alias("n")).collect()}
    assert sums == {"n_items": 1000, "n_results": 2000}
