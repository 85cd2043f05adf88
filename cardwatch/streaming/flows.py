"""The streaming flows: the same operators as the batch queries on streamed rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import (
    AVERAGE_SLIDE_S,
    THROUGHPUT_WINDOW_S,
)
from cardwatch.operators import metrics, verdicts, windows
from cardwatch.operators.rules import Registry
from cardwatch.sources import sinks
from cardwatch.streaming.ordered import score_live, still_needed

BatchWriter = Callable[[DataFrame, int], None]


def versions(path: str, *keys: str, fold_every: int = 20, keep: int = 2) -> BatchWriter:
    """Write each micro-batch as one version of the keyed table at ``path``.

    With keys, the versions are folded into a snapshot every so many batches, and what
    the newest ``keep`` snapshots replace is removed.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        sinks.write_version(rows, path, batch_id)
        if keys and batch_id % fold_every == fold_every - 1:
            sinks.compact(rows.sparkSession, path, keys, batch_id)
            sinks.vacuum(rows.sparkSession, path, keep)

    return write


def appended(path: str, *keys: str, fold_every: int = 20, keep: int = 2) -> BatchWriter:
    """Append each micro-batch to the lists of the table at ``path``; folded and cleaned up every so many batches."""

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        sinks.write_version(rows, path, batch_id)
        if batch_id % fold_every == fold_every - 1:
            sinks.compact_entries(spark, path, keys, batch_id)
            sinks.vacuum(spark, path, keep)

    return write


def summed(
    path: str,
    keys: Sequence[str],
    fields: Sequence[str],
    fold: Callable[[DataFrame], DataFrame],
    fold_every: int = 20,
    keep: int = 2,
) -> BatchWriter:
    """Fold each micro-batch to parts of sums and keep them at ``path``; ``sinks.read_summed`` adds them up.

    The stream itself has no state and needs no watermark: no row is too late, and a batch given
    twice replaces its parts. The table holds a row per key, as any result of the sums would.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        sinks.write_version(fold(rows), path, batch_id)
        if batch_id % fold_every == fold_every - 1:
            sinks.compact_summed(spark, path, keys, fields, batch_id)
            sinks.vacuum(spark, path, keep)

    return write


def with_ingestion_time(rows: DataFrame) -> DataFrame:
    """Arrival time as event time, so that no row is ever late."""
    return rows.withColumn("ts", F.current_timestamp())


# --- envelopes ------------------------------------------------------------------

def envelopes(items: DataFrame, registry: Registry, routed_ms: Column) -> DataFrame:
    """Items wrapped with the number of rule sets that apply and their routing time."""
    fields = [F.col(c) for c in items.columns]
    return items.select(
        F.col("id").alias("item_id"),
        F.struct(*fields).alias("item"),
        verdicts.applicable_count(registry),
        routed_ms.alias("t_routed"),
    )


def unwrapped(carriers: DataFrame) -> DataFrame:
    return carriers.select("item.*")


# --- windows --------------------------------------------------------------------

def _watermarked(rows: DataFrame, delay_s: int | None) -> DataFrame:
    """Rows with a watermark so far behind their event time; without one, no row is ever late."""
    return rows if delay_s is None else rows.withWatermark("ts", f"{delay_s} seconds")


def slice_stream(transactions: DataFrame, delay_s: int | None = None) -> DataFrame:
    """Running (sum, count) per merchant and slide interval, however the rows fall into batches.

    State is kept for every interval unless a delay bounds it; rows later than that are
    dropped then, and ``runs.progress`` counts them. Holding intervals instead of the windows over them keeps one state row where
    the sliding window itself would keep twenty.
    """
    slice_window = F.window("ts", f"{AVERAGE_SLIDE_S} seconds").alias("w")
    number = F.floor(F.unix_seconds(F.col("w.start")) / AVERAGE_SLIDE_S)
    return (
        _watermarked(transactions.where(F.col("merchant_id").isNotNull()), delay_s)
        .groupBy("merchant_id", slice_window)
        .agg(F.sum("amount").alias("total"), F.count("amount").alias("n"))
        .select("merchant_id", number.alias("slice"), "total", "n")
    )


def throughput_stream(items: DataFrame, delay_s: int | None = None) -> DataFrame:
    """Items per tumbling window so far; the delay as in ``slice_stream``."""
    return windows.tumbling_counts(_watermarked(items, delay_s), THROUGHPUT_WINDOW_S)


# --- assembly -------------------------------------------------------------------

def assembly_stream(postings: DataFrame, rulesets: list[str], ttl_s: int | None = None) -> DataFrame:
    """Results collected per item as they arrive; with ``ttl_s``, state is dropped so long after the item.

    Without it no item times out, and none is lost to the order of the batches. Every result carries its item's event time, so the watermark can expire items
    that never complete. Update mode reports completions at once; append mode
    reports each item a single time when it expires.
    """
    return verdicts.assembled_stream_outcomes(
        _watermarked(postings, ttl_s), rulesets, keys=("item_id", "ts")
    )


def expired(assembled: DataFrame) -> DataFrame:
    """Append-mode rows marked COMPLETE or TIMED_OUT."""
    done = F.col("n_posted") >= F.col("n_applicable")
    return assembled.withColumn(
        "status", F.when(done, F.lit("COMPLETE")).otherwise(F.lit("TIMED_OUT"))
    )


# --- metrics --------------------------------------------------------------------

def counter_stream(timed: DataFrame, registry: Registry) -> DataFrame:
    """All counters since the start: one row, for complete mode."""
    return timed.groupBy().agg(*metrics.all_counters(registry))


def metric_writer(spark: SparkSession, registry: Registry, path: str) -> BatchWriter:
    """Write a metric reading per batch, as rows and as text lines; ``pump.MetricPump`` reads per tick instead."""

    def write(totals: DataFrame, batch_id: int) -> None:
        completions = f"{path}/completions"
        before = F.lit(0)
        if batch_id > 0:
            earlier = spark.read.parquet(f"{completions}/batch_id={batch_id - 1}")
            before = earlier.agg(F.max("latency_items")).scalar()
        sinks.write_version(totals.select("latency_items"), completions, batch_id)
        if batch_id > 1:
            sinks.remove(spark, f"{completions}/batch_id={batch_id - 2}")
        values = metrics.reading(totals, registry, before)
        sinks.write_version(values, f"{path}/readings", batch_id)
        sinks.write_lines(metrics.metric_lines(values), f"{path}/lines", batch_id)

    return write


# --- live averages --------------------------------------------------------------

def feedback_writer(spark: SparkSession, merchants: DataFrame, path: str) -> BatchWriter:
    """Score each batch on arrival with the averages kept up by the batches before it.

    ``ordered.OrderedScoring`` scores in event time instead.

    The kept slices alternate between two folders: a batch reads its predecessor's
    and replaces its own, so a repeated batch sees the same input.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transactions = batch.persist()
        try:
            slices = windows.merchant_slices(transactions)
            if batch_id > 0:
                kept = spark.read.parquet(f"{path}/slices/{(batch_id - 1) % 2}")
                slices = slices.unionByName(kept).groupBy("merchant_id", "slice").agg(
                    F.sum("total").alias("total"), F.sum("n").alias("n")
                )
            sinks.write_version(
                score_live(transactions, slices, merchants), f"{path}/verdicts", batch_id
            )
            still_needed(slices).write.mode("overwrite").parquet(f"{path}/slices/{batch_id % 2}")
        finally:
            transactions.unpersist()

    return write
