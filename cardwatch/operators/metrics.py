"""Counters, latencies, throughput and dashboard values.

Everything starts from ``tick_counters``: one pass folds the evaluated items to
one small row per metric interval, and every later step works on those rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.fixed_values import (
    ALL_PAYMENTS,
    DASHBOARD_BANDS,
    DASHBOARD_SPAN_S,
    FRAUD_RATE,
    GROUP_PAYMENTS,
    INTERNAL_COUNTER_PREFIX,
    MEAN_LATENCY,
    MERCHANT_GROUPS,
    METRIC_INTERVAL_S,
    PAYMENT_RATE,
)
from cardwatch.functions import scalars
from cardwatch.functions.aggregates import count_when
from cardwatch.operators.blocks import running_totals
from cardwatch.operators.rules import Registry
from cardwatch.operators.verdicts import counter_columns, verdict_column
from cardwatch.operators.windows import interval_number

# Intervals per block of the running totals: one day of intervals.
_BLOCK = 86_400 // METRIC_INTERVAL_S


def merchant_group_columns(merchant_id: Column) -> list[Column]:
    """One counter per named merchant number range; ids that are no number count nowhere."""
    number = scalars.parsed_id(merchant_id)
    return [
        count_when(number.between(low, high)).alias(f"n_{name}")
        for name, (low, high) in MERCHANT_GROUPS.items()
    ]


def with_stage_times(items: DataFrame, number: Column) -> DataFrame:
    """Repeatable stage times in epoch milliseconds, derived from the arrival time."""
    routed = scalars.epoch_millis(F.col("ts"))
    return items.withColumns({
        "t_routed": routed,
        "t_executor": routed + number % 20,
        "t_aggregator": routed + number % 20 + number % 35,
    })


def stage_latencies(items: DataFrame) -> DataFrame:
    """Time per stage; ``clock_error`` marks items that stop before they start."""
    return items.withColumns({
        "to_executor_ms": F.col("t_executor") - F.col("t_routed"),
        "to_aggregator_ms": F.col("t_aggregator") - F.col("t_executor"),
        "latency_ms": scalars.latency_millis(F.col("t_routed"), F.col("t_aggregator")),
        "clock_error": F.col("t_aggregator") < F.col("t_routed"),
    })


def latency_columns() -> list[Column]:
    """Sum and count of valid latencies over rows with ``latency_ms``."""
    return [
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("total_latency_ms"),
        F.count("latency_ms").alias("latency_items"),
    ]


def latency_summary(timed: DataFrame) -> DataFrame:
    return timed.agg(*latency_columns()).withColumns({
        "avg_latency_ms": F.round(F.try_divide("total_latency_ms", "latency_items"), 6),
        "whole_avg_latency_ms": F.floor(F.try_divide("total_latency_ms", "latency_items")),
    })


def all_counters(registry: Registry) -> list[Column]:
    """Every counter over evaluated, timed items."""
    rejects = [
        count_when(scalars.is_rejected(F.col(verdict_column(n))["outcome"])).alias(f"rejects_{n}")
        for n, _ in registry.active()
    ]
    return [
        *counter_columns(registry),
        *merchant_group_columns(F.col("merchant_id")),
        *latency_columns(),
        *rejects,
        F.max("ts").alias("last_ts"),
    ]


def tick_counters(timed: DataFrame, registry: Registry) -> DataFrame:
    """All counters per metric interval."""
    tick = interval_number(F.col("ts"), METRIC_INTERVAL_S).alias("tick")
    return timed.groupBy(tick).agg(*all_counters(registry))


def _rate(part: Column, whole: Column) -> Column:
    """Share of the whole, 0 while the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _named_values(registry: Registry) -> Column:
    """(name, value, is_count) per metric, from one row of totals."""
    rates = {
        FRAUD_RATE:
            F.round(_rate(F.col("rejected_fraud_events"), F.col("latency_items")), 6),
        PAYMENT_RATE:
            F.col("interval_completions") / METRIC_INTERVAL_S,
        ALL_PAYMENTS: F.col("latency_items"),
        MEAN_LATENCY:
            F.round(F.try_divide("total_latency_ms", "latency_items"), 6),
    }
    counts = {
        metric: F.col(f"n_{name}") for name, metric in GROUP_PAYMENTS.items()
    }
    entries = [
        _metric(F.lit(name), value, is_count)
        for values, is_count in ((rates, False), (counts, True))
        for name, value in values.items()
    ]
    entries += [
        F.when(
            F.col(f"rejects_{n}") > 0,
            _metric(
                scalars.reject_metric_name(F.lit(s.qualified_name)), F.col(f"rejects_{n}"), True
            ),
        )
        for n, s in registry.active()
    ]
    return F.array(*entries)


def _listed(rows: DataFrame, registry: Registry, time: str) -> DataFrame:
    """One row per metric that has a value."""
    return rows.select(time, F.inline(_named_values(registry))).where("value IS NOT NULL")


def _metric(name: Column, value: Column, is_count: bool) -> Column:
    return F.struct(
        name.alias("name"), value.cast("double").alias("value"), F.lit(is_count).alias("is_count")
    )


def reading_counters(registry: Registry) -> list[str]:
    """The counters a reading is made of. Completions are the items with a latency."""
    return [
        "rejected_fraud_events", *[f"n_{name}" for name in MERCHANT_GROUPS],
        "total_latency_ms", "latency_items",
        *[f"rejects_{n}" for n, _ in registry.active()],
    ]


def _tick_end(tick: Column) -> Column:
    return (tick + 1) * METRIC_INTERVAL_S


def snapshot(ticks: DataFrame, registry: Registry, time: str = "epoch_s") -> DataFrame:
    """Current value of every metric: (time, name, value, is_count).

    ``time`` is ``epoch_s``, when the newest item arrived, or ``tick_s``, the end
    of its interval.
    """
    totals = ticks.agg(
        *[F.sum(c).alias(c) for c in reading_counters(registry)],
        F.max_by("latency_items", "tick").alias("interval_completions"),
        F.unix_seconds(F.max("last_ts")).alias("epoch_s"),
        _tick_end(F.max("tick")).alias("tick_s"),
    )
    return _listed(totals, registry, time)


def reading(totals: DataFrame, registry: Registry, previous_completions: Column) -> DataFrame:
    """One reading of the metric pump from running totals and the reading before it."""
    return totals.withColumns({
        "interval_completions": F.col("latency_items") - previous_completions,
        "epoch_s": F.unix_seconds("last_ts"),
    }).transform(_listed, registry, "epoch_s")


def series(ticks: DataFrame, registry: Registry) -> DataFrame:
    """What the metric pump reports at each interval with activity: (tick_s, name, value)."""
    counters = reading_counters(registry)
    per_interval = ticks.withColumn("interval_completions", F.col("latency_items"))
    running = running_totals(per_interval, "tick", counters, _BLOCK)
    return _readings(running, registry)


def _readings(running: DataFrame, registry: Registry) -> DataFrame:
    ended = running.select("*", _tick_end(F.col("tick")).alias("tick_s"))
    return _listed(ended, registry, "tick_s").drop("is_count")


def tick_readings(running: DataFrame, registry: Registry) -> DataFrame:
    """Readings with the end of their tick and the time of its newest item."""
    ended = running.select(
        "*", F.struct(_tick_end(F.col("tick")).alias("tick_s"), F.unix_seconds("last_ts").alias("epoch_s")).alias("at")
    )
    return _listed(ended, registry, "at").select("at.*", "name", "value", "is_count")


def panel(timed: DataFrame, registry: Registry, newest: Column) -> DataFrame:
    """The readings of a dashboard panel: its span before the newest reading.

    ``newest`` is the time of the newest item. Everything before the span folds to one row as
    the span's ticks fold to theirs, so the items are read once and only a span of rows is accumulated.
    """
    counters = reading_counters(registry)
    start = interval_number(newest, METRIC_INTERVAL_S) - DASHBOARD_SPAN_S // METRIC_INTERVAL_S
    tick = F.greatest(interval_number(F.col("ts"), METRIC_INTERVAL_S), start).alias("tick")
    folded = timed.groupBy(tick).agg(*all_counters(registry))
    so_far = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    running = folded.withColumn("interval_completions", F.col("latency_items")).withColumns({
        c: F.sum(c).over(so_far) for c in counters
    })
    return _readings(running.where(F.col("tick") > start), registry)


def tick_completions(timed: DataFrame) -> DataFrame:
    """Completions per metric interval."""
    tick = interval_number(F.col("ts"), METRIC_INTERVAL_S).alias("tick")
    return timed.groupBy(tick).agg(F.count("latency_ms").alias("latency_items"))


def payment_rate(ticks: DataFrame) -> DataFrame:
    """Total completions at each reading and the rate since the reading before it.

    Readings come every interval, so the difference is the interval's own count.
    """
    counted = ticks.select(
        "tick",
        F.col("latency_items").alias("interval_completions"),
        F.col("latency_items").alias("completions"),
    )
    return running_totals(counted, "tick", ["completions"], _BLOCK).select(
        _tick_end(F.col("tick")).alias("tick_s"),
        "completions",
        (F.col("interval_completions") / METRIC_INTERVAL_S).alias("payments_per_s"),
    )


def metric_lines(values: DataFrame) -> DataFrame:
    """Text lines; counters print as whole numbers, everything else as decimals."""
    text = F.when(F.col("is_count"), F.col("value").cast("bigint").cast("string")).otherwise(
        F.col("value").cast("string")
    )
    line = scalars.metric_line(F.col("name"), text, F.col("epoch_s"))
    return values.select(line.alias("line"))


def band(metric: str, value: Column) -> Column:
    """Dashboard colour: the band a value falls in, bounds belonging to the upper band."""
    low, high, below, between, above = DASHBOARD_BANDS[metric]
    return (
        F.when(value < low, F.lit(below))
        .when(value < high, F.lit(between))
        .when(value.isNotNull(), F.lit(above))
    )


def dashboard(current: DataFrame) -> DataFrame:
    """Current value and colour of each banded metric, from a snapshot by ``tick_s``."""
    colour = reduce(
        lambda rest, metric: F.when(
            F.col("name") == metric, band(metric, F.col("value"))
        ).otherwise(rest),
        DASHBOARD_BANDS,
        F.lit(None).cast("string"),
    )
    banded = F.col("name").isin(list(DASHBOARD_BANDS))
    return current.where(banded).select(
        "name", "value", F.col("tick_s").alias("at_s"), colour.alias("colour")
    )


def reject_counters(counters: DataFrame) -> DataFrame:
    """Counters that belong to rule sets, found by not carrying the internal prefix."""
    return counters.where(~F.col("name").startswith(INTERNAL_COUNTER_PREFIX))


def _throughput(counted: DataFrame) -> DataFrame:
    """Elapsed time as text and whole items per second, from n_items and elapsed_ms."""
    seconds = F.floor(F.col("elapsed_ms") / 1000)
    return counted.withColumns({
        "elapsed": scalars.elapsed_text(F.col("elapsed_ms")),
        "tps": F.floor(F.try_divide(F.col("n_items"), seconds)),
    })


def ruleset_throughput(postings: DataFrame) -> DataFrame:
    """Items, elapsed time and whole items per second of every rule set."""
    return _throughput(postings.groupBy("ruleset").agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.max("posted_ms") - F.min("posted_ms")).alias("elapsed_ms"),
    ))


# The stage that assembles the results of all sets.
AGGREGATOR = "Aggregator"


def stage_report(postings: DataFrame, timed: DataFrame) -> DataFrame:
    """The throughput of every rule set and of the aggregator, which also has the mean latency of its items."""
    sets = ruleset_throughput(postings).withColumnRenamed("ruleset", "stage").withColumn("avg_latency_ms", F.lit(None).cast("double"))
    ended = timed.agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.max("t_aggregator") - F.min("t_aggregator")).alias("elapsed_ms"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    ).where("n_items > 0")
    return sets.unionByName(_throughput(ended).withColumn("stage", F.lit(AGGREGATOR)))


def run_summary(timed: DataFrame) -> DataFrame:
    """End-of-run line: elapsed, completions, whole items per second, whole mean latency."""
    totals = timed.agg(
        (F.max("t_aggregator") - F.min("t_routed")).alias("elapsed_ms"),
        *latency_columns(),
    )
    seconds = F.floor((F.col("elapsed_ms") + 500) / 1000)
    return totals.select(
        scalars.elapsed_text(F.col("elapsed_ms")).alias("elapsed"),
        seconds.alias("elapsed_s"),
        F.col("latency_items").alias("completions"),
        F.floor(F.try_divide(F.col("latency_items"), seconds)).alias("tps"),
        F.floor(F.try_divide("total_latency_ms", "latency_items")).alias("avg_latency_ms"),
    )


def backlog(loaded: DataFrame, finished: DataFrame) -> DataFrame:
    """Loaded, completed and still waiting items."""
    counts = (
        loaded.select(F.lit(1).alias("loaded"), F.lit(0).alias("completed"))
        .unionAll(finished.select(F.lit(0), F.lit(1)))
        .agg(
            F.coalesce(F.sum("loaded"), F.lit(0)).alias("loaded"),
            F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"),
        )
    )
    return counts.withColumn("backlog", F.col("loaded") - F.col("completed"))
