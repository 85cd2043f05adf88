"""Streams over several files and batches against their batch answers."""

import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from cardwatch.fixed_values import IDLE_LIMIT_S
from cardwatch.operators import metrics, verdicts, windows
from cardwatch.operators.rules import default_registry
from cardwatch.plans import batch, inputs, streams
from cardwatch.sources import bank, replay, sinks
from cardwatch.streaming import flows, runs


@pytest.fixture(scope="module")
def pieces(spark, sf, tmp_path_factory):
    """The given tables with events as a folder of four files in time order."""
    folder = tmp_path_factory.mktemp("pieces")
    for name in ("customer", "supplier"):
        shutil.copy(f"{sf}/{name}.parquet", folder)
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").coalesce(1)
    os.mkdir(f"{folder}/events.parquet")
    for part in range(4):
        # A write's own folder is moved aside: only its data file joins the table.
        events.where(F.floor(F.col("event_id") / 250) == part).write.parquet(f"{folder}/part{part}")
        data = [f for f in os.listdir(f"{folder}/part{part}") if f.endswith(".parquet")]
        target = f"{folder}/events.parquet/{part}.parquet"
        shutil.copy(f"{folder}/part{part}/{data[0]}", target)
        os.utime(target, (time.time() - 100 + part, time.time() - 100 + part))
    return str(folder)


def stored(spark, folder, per_trigger=1):
    return streams.streamed_transactions(spark, folder, per_trigger)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_verdicts_over_batches(spark, pieces, tmp_path):
    judged = inputs.judge(stored(spark, pieces), bank.merchants(spark, pieces), default_registry())
    kept = judged.select("id", "final_status")
    query = runs.drain(runs.start_to_files(kept, f"{tmp_path}/o", f"{tmp_path}/c"))
    reported = runs.progress(spark, query)
    assert reported.where("input_rows > 0").count() == 4
    report = runs.pacing_report(reported, interval_ms=0).first()
    assert report.input_rows == 1000 and report.overran == report.batches
    expected = inputs.judged(spark, pieces).select("id", "final_status")
    assert rows(spark.read.parquet(f"{tmp_path}/o")) == rows(expected)


def test_restart_goes_on_where_it_stopped(spark, pieces, tmp_path):
    def run():
        ids = stored(spark, pieces).select("id")
        return runs.drain(runs.start_to_files(ids, f"{tmp_path}/o", f"{tmp_path}/c"))

    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/o").count() == 1000


def test_slices_over_batches(spark, pieces, tmp_path):
    slices = flows.slice_stream(stored(spark, pieces))
    runs.drain(runs.start_batches(slices, flows.versions(f"{tmp_path}/o"), f"{tmp_path}/c"))
    newest = sinks.read_newest(spark, f"{tmp_path}/o", "merchant_id", "slice")
    assert rows(inputs.shown(windows.sliding_average(newest), "avg_amount")) == rows(batch.sliding_merchant_avg(spark, pieces))


@pytest.mark.parametrize("per_trigger", [1, 2, 4])
def test_files_out_of_order_lose_nothing(spark, pieces, tmp_path, per_trigger):
    """Files picked up latest first, in one to four batches."""
    for name in ("customer", "supplier"):
        shutil.copy(f"{pieces}/{name}.parquet", tmp_path)
    shutil.copytree(f"{pieces}/events.parquet", f"{tmp_path}/events.parquet")
    for part in range(4):
        at = time.time() - 100 - 10 * part
        os.utime(f"{tmp_path}/events.parquet/{part}.parquet", (at, at))
    folder = str(tmp_path)
    slices = flows.slice_stream(stored(spark, folder, per_trigger))
    runs.drain(runs.start_batches(slices, flows.versions(f"{folder}/s"), f"{folder}/c1"))
    newest = sinks.read_newest(spark, f"{folder}/s", "merchant_id", "slice")
    assert rows(inputs.shown(windows.sliding_average(newest), "avg_amount")) == rows(batch.sliding_merchant_avg(spark, pieces))
    judged = inputs.judge(stored(spark, folder, per_trigger), bank.merchants(spark, folder), default_registry())
    assembled = flows.assembly_stream(inputs.post(judged, default_registry()), inputs.ruleset_names())
    done = verdicts.complete(assembled).select("item_id", "n_posted")
    runs.drain(runs.start_batches(done, flows.versions(f"{folder}/a"), f"{folder}/c2"))
    assert rows(sinks.read_newest(spark, f"{folder}/a", "item_id")) == rows(batch.complete_items(spark, pieces))


def test_assembly_over_batches(spark, pieces, tmp_path):
    judged = inputs.judge(stored(spark, pieces), bank.merchants(spark, pieces), default_registry())
    assembled = flows.assembly_stream(inputs.post(judged, default_registry()), inputs.ruleset_names())
    done = verdicts.complete(assembled).select("item_id", "n_posted")
    runs.drain(runs.start_batches(done, flows.versions(f"{tmp_path}/o"), f"{tmp_path}/c"))
    newest = sinks.read_newest(spark, f"{tmp_path}/o", "item_id")
    assert rows(newest) == rows(batch.complete_items(spark, pieces))


def test_live_feedback_over_batches(spark, pieces, tmp_path):
    writer = flows.feedback_writer(spark, bank.merchants(spark, pieces), str(tmp_path))
    runs.drain(runs.start_batches(stored(spark, pieces), writer, f"{tmp_path}/c", mode="append"))
    scored = spark.read.parquet(f"{tmp_path}/verdicts").drop("batch_id")
    assert rows(inputs.shown(scored, "average")) == rows(batch.asof_feedback(spark, pieces))
    assert sorted(os.listdir(f"{tmp_path}/slices")) == ["0", "1"]


def test_feedback_batch_may_be_repeated(spark, sf, tmp_path):
    txns = bank.transactions(spark, sf)
    halves = [txns.where(F.col("id") < "00000000000500"), txns.where(F.col("id") >= "00000000000500")]
    writer = flows.feedback_writer(spark, bank.merchants(spark, sf), str(tmp_path))
    for batch_id in (0, 1, 1):
        writer(halves[batch_id], batch_id)
    scored = spark.read.parquet(f"{tmp_path}/verdicts").drop("batch_id")
    assert rows(inputs.shown(scored, "average")) == rows(batch.asof_feedback(spark, sf))


def test_metric_readings_and_rate(spark, pieces, tmp_path):
    registry = default_registry()
    judged = inputs.judge(stored(spark, pieces), bank.merchants(spark, pieces), registry)
    timed = metrics.stage_latencies(metrics.with_stage_times(judged, inputs.txn_number()))
    writer = flows.metric_writer(spark, registry, str(tmp_path))
    totals = flows.counter_stream(timed, registry)
    runs.drain(runs.start_batches(totals, writer, f"{tmp_path}/c", mode="complete"))
    readings = spark.read.parquet(f"{tmp_path}/readings")
    rates = readings.where("name = 'bib.payment.rate'").orderBy("batch_id").collect()
    assert [r.value for r in rates] == [50.0] * 4
    counts = readings.where("name = 'bib.payments.all'").orderBy("batch_id").collect()
    assert [r.value for r in counts] == [250.0, 500.0, 750.0, 1000.0]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/lines/batch_id=3").collect()]
    assert any(line.startswith("bib.payments.all 1000.0 ") and line.endswith(" ") for line in lines)


def test_items_expire_once_as_complete_or_timed_out(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = ("item_id string, ts timestamp, ordinal int, ruleset string, n_applicable int, "
              "outcome string, posted_ms long")

    def post(_, *entries):
        made = [(i, start + dt.timedelta(seconds=s), n, r, 2, "Approved", s * 1000) for i, s, n, r in entries]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)

    post(0, ("a", 0, 0, "x"), ("a", 0, 1, "y"), ("b", 10, 0, "x"))
    post(1, ("late", 1000, 0, "x"))
    post(2, ("mid", 1100, 0, "x"))  # the watermark of one batch drops late rows from the next but one
    post(3, ("b", 10, 1, "y"), ("end", 2000, 0, "x"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    out = flows.expired(flows.assembly_stream(stream, ["x", "y"], ttl_s=IDLE_LIMIT_S))
    query = runs.drain(runs.start_to_files(out.drop("results"), f"{tmp_path}/o", f"{tmp_path}/c"))
    status = {r.item_id: r.status for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert status == {"a": "COMPLETE", "b": "TIMED_OUT", "late": "TIMED_OUT", "mid": "TIMED_OUT"}
    dropped = runs.pacing_report(runs.progress(spark, query), 0).first().dropped_late_rows
    assert dropped == 1  # b's second result came after b had expired


def test_paced_replay_numbers_wrap(spark, sf, tmp_path):
    ticks = (
        spark.readStream.format("rate-micro-batch").option("rowsPerBatch", "700")
        .option("numPartitions", "2").load()
    )
    txns = bank.transactions(spark, sf)
    flow = flows.with_ingestion_time(replay.number_stream(ticks, txns, 1000))
    query = (
        flow.select("id", "amount", "ts").writeStream.format("parquet").option("path", f"{tmp_path}/o")
        .option("checkpointLocation", f"{tmp_path}/c").start()
    )
    deadline = time.time() + 60
    while time.time() < deadline and sum(p.numInputRows for p in query.recentProgress) < 1400:
        time.sleep(0.2)
    query.stop()
    found = spark.read.parquet(f"{tmp_path}/o").where("id < '00000000001400'")
    assert found.select("id").distinct().count() == 1400
    first, again = (found.where(F.col("id") == i).first() for i in ("00000000000005", "00000000001005"))
    assert first.amount == again.amount


def test_paced_source_is_a_stream(spark, sf):
    assert replay.paced(spark, bank.transactions(spark, sf), 1000, 2000).isStreaming


def test_envelopes_unwrap(spark, sf):
    txns = bank.transactions(spark, sf)
    carriers = flows.envelopes(txns, default_registry(), F.unix_millis("ts"))
    assert rows(flows.unwrapped(carriers)) == rows(txns)
    assert carriers.where("n_applicable = 2").count() == 1000
