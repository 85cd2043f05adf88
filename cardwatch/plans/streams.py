"""The registered streaming queries: run over the given tables, then read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import THROUGHPUT_WINDOW_S
from cardwatch.functions import scalars
from cardwatch.operators import metrics, waterfall, windows
from cardwatch.operators.rules import default_registry
from cardwatch.plans import inputs
from cardwatch.session import work_dir
from cardwatch.sources import bank, sinks
from cardwatch.sources.schemas import GIVEN
from cardwatch.streaming import flows, runs
from cardwatch.streaming.assembly import Assembly
from cardwatch.streaming.cleanup import PendingItems
from cardwatch.streaming.ordered import OrderedScoring
from cardwatch.streaming.pump import MetricPump
from cardwatch.streaming.stages import StagedFlow

QUERIES: dict = {}


def registered(query):
    QUERIES[query.__name__] = query
    return query


# Files a batch takes at most, so that no batch grows with the table.
FILES_PER_TRIGGER = 8

# How far files may be out of order for live averages and for metric readings.
FEEDBACK_DELAY_S = 86_400
PUMP_DELAY_S = 3_600


def streamed_transactions(spark: SparkSession, sf: str, files_per_trigger: int = FILES_PER_TRIGGER):
    events = runs.stored_stream(runs.prepare(spark), sf, "events", GIVEN["events"], files_per_trigger)
    return bank.transactions_from(events, bank.merchant_count(spark, sf))


def streamed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.judge(
        streamed_transactions(spark, sf), bank.merchants(spark, sf), default_registry()
    )


@registered
def stream_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "verdicts")
    rows = streamed_verdicts(spark, sf).select(
        "id", "n_applicable", "final_status", "rejecting_ruleset", "rejecting_reason",
        "n_rejecting",
    )
    runs.drain(runs.start_to_files(rows, f"{folder}/rows", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/rows")


@registered
def stream_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "envelopes")
    txns = streamed_transactions(spark, sf)
    carriers = flows.envelopes(txns, default_registry(), scalars.epoch_millis(F.col("ts")))
    runs.drain(runs.start_to_files(carriers, f"{folder}/rows", f"{folder}/checkpoint"))
    stored = spark.read.parquet(f"{folder}/rows")
    return stored.select("item_id", "n_applicable", "t_routed", F.col("item.amount").alias("amount"))


@registered
def stream_throughput(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "throughput")
    writer = flows.summed(f"{folder}/rows", ["window_end_s"], ["n_items"], lambda rows: windows.tumbling_counts(rows).drop("tps"))
    runs.drain(runs.start_batches(streamed_transactions(spark, sf), writer, f"{folder}/checkpoint", mode="append"))
    counts = sinks.read_summed(spark, f"{folder}/rows", ["window_end_s"], ["n_items"])
    return counts.withColumn("tps", scalars.throughput_text(F.col("n_items"), THROUGHPUT_WINDOW_S))


def _streamed_slices(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "averages")
    keys, fields = ["merchant_id", "slice"], ["total", "n"]
    writer = flows.summed(f"{folder}/rows", keys, fields, windows.merchant_slices)
    runs.drain(runs.start_batches(streamed_transactions(spark, sf), writer, f"{folder}/checkpoint", mode="append"))
    return sinks.read_summed(spark, f"{folder}/rows", keys, fields)


@registered
def stream_merchant_avg(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.shown(windows.sliding_average(_streamed_slices(spark, sf)), "avg_amount")


@registered
def stream_updated_merchants(spark: SparkSession, sf: str) -> DataFrame:
    now = bank.given(spark, sf, "events").agg(
        windows.interval_number(F.max(F.col("ts").cast("timestamp")), windows.AVERAGE_SLIDE_S)
    ).scalar()
    averages = windows.current_average(_streamed_slices(spark, sf), now)
    return inputs.shown(windows.updated_merchants(bank.merchants(spark, sf), averages), "avg_txn_amount")


@registered
def stream_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Every item that finished, once: complete, or timed out without all results."""
    assembly = Assembly(spark, work_dir(spark, "assembly"))
    postings = inputs.post(streamed_verdicts(spark, sf), default_registry())
    runs.drain(runs.start_batches(postings, assembly.writer(), f"{assembly.path}/checkpoint", mode="append"))
    results = F.transform("results", lambda r: F.concat(r["ruleset"], F.lit("="), r["result"]["outcome"]))
    return assembly.reports().select("item_id", "status", "n_posted", F.concat_ws("|", results).alias("results"))


@registered
def stream_stage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Router, executors and aggregator as streams of their own: what each handled, and whether the measured times are in order.

    The times themselves differ from run to run and are left out.
    """
    flow = StagedFlow(spark, bank.merchants(spark, sf), default_registry(), work_dir(spark, "stages"))
    runs.drain(flow.route(streamed_transactions(spark, sf)))
    runs.drain(flow.execute())
    runs.drain(flow.aggregate())
    times = flow.timed_items().agg(
        F.bool_and((F.col("t_routed") <= F.col("t_executor")) & (F.col("t_executor") <= F.col("t_aggregator"))).alias("in_order")
    ).scalar()
    return flow.report().select(
        "stage", "n_items", times.alias("in_order"), (F.col("avg_latency_ms") >= 0).alias("has_latency")
    )


@registered
def stream_pending_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that still wait after the stream, from tables that finished items have left."""
    items = PendingItems(spark, work_dir(spark, "pending"))
    postings = inputs.post(streamed_verdicts(spark, sf), default_registry())
    runs.drain(runs.start_batches(postings, items.writer(), f"{items.path}/checkpoint", mode="append"))
    listed = sinks.read_lists(spark, items.results_path, ["item_id"], ["ruleset", "outcome"], "results")
    said = F.transform("results", lambda r: F.concat(r["ruleset"], F.lit("="), r["outcome"]))
    return items.pending().join(listed, "item_id").select("item_id", "n_applicable", "n_results", F.concat_ws("|", said).alias("results"))


@registered
def stream_credit_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The credit flow as a stream: every batch appends what all rules say about its items."""
    folder = work_dir(spark, "credit-lists")
    rules = waterfall.running_credit_rules()
    entries = waterfall.credit_entries(
        streamed_transactions(spark, sf), bank.accounts(spark, sf), rules, inputs.rule_names(spark, rules)
    )
    writer = flows.appended(f"{folder}/lists", "id")
    runs.drain(runs.start_batches(entries, writer, f"{folder}/checkpoint", mode="append"))
    return inputs.credit_lists(spark, f"{folder}/lists")


def _pumped(spark: SparkSession, sf: str) -> MetricPump:
    staged = metrics.with_stage_times(streamed_verdicts(spark, sf), inputs.txn_number())
    pump = MetricPump(spark, default_registry(), work_dir(spark, "metrics"), delay_s=PUMP_DELAY_S)
    query = runs.drain(pump.start(metrics.stage_latencies(staged), live=False))
    pump.finish(runs.last_batch(query))
    return pump


@registered
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The last reading of the metric pump."""
    readings = _pumped(spark, sf).readings()
    newest = readings.agg(F.max("tick_s")).scalar()
    return readings.where(F.col("tick_s") == newest).select("name", "value", "epoch_s")


@registered
def stream_metric_series(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading the metric pump made."""
    return _pumped(spark, sf).readings().select("tick_s", "name", "value")


@registered
def stream_feedback(spark: SparkSession, sf: str) -> DataFrame:
    scoring = OrderedScoring(spark, bank.merchants(spark, sf), work_dir(spark, "feedback"), delay_s=FEEDBACK_DELAY_S)
    query = runs.drain(
        runs.start_batches(streamed_transactions(spark, sf), scoring.writer(), f"{scoring.path}/checkpoint", mode="append")
    )
    scoring.finish(runs.last_batch(query))
    return inputs.shown(scoring.verdicts(), "average")
