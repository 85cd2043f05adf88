"""The metric pump: every reading of the dashboard, tick by tick in event time.

Counters of a batch fold to one row per tick. Ticks are open until the event time is
``delay_s`` past them; then they close in order, and each closed tick is one reading made of
the totals up to it. The totals are carried from batch to batch as one row, and open ticks
as one row each, so a reading doesn't depend on how rows fall into batches and
no batch looks back further than the open ticks. Counts that arrive for a closed tick are
kept apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from cardwatch.fixed_values import METRIC_INTERVAL_S
from cardwatch.operators import metrics
from cardwatch.operators.rules import Registry
from cardwatch.operators.windows import interval_number
from cardwatch.sources import sinks
from cardwatch.streaming import runs
from cardwatch.streaming.carried import Carried

# How often a live pump runs.
TRIGGER = f"{METRIC_INTERVAL_S} seconds"


class MetricPump:
    """The tables of a pump under ``path``: open ticks, totals, readings, text lines, late counts."""

    def __init__(self, spark: SparkSession, registry: Registry, path: str, delay_s: int = METRIC_INTERVAL_S):
        self.spark, self.registry, self.path, self.delay_s = spark, registry, path, delay_s
        self.counters = metrics.reading_counters(registry)
        counts = ", ".join(f"{c} long" for c in self.counters)
        self.ticks = Carried(spark, f"{path}/ticks", f"tick long, {counts}, last_ts timestamp")
        # What all closed ticks add up to, and the first tick that isn't closed.
        self.totals = Carried(spark, f"{path}/totals", f"{counts}, first_open long")

    def writer(self) -> Callable[[DataFrame, int], None]:
        return self._write

    def start(self, timed: DataFrame, live: bool = True) -> StreamingQuery:
        """Pump a stream of judged, timed items: every ``TRIGGER`` while live, else all there is."""
        trigger = {"processingTime": TRIGGER} if live else {"availableNow": True}
        return runs.start_batches(timed, self._write, f"{self.path}/checkpoint", mode="append", **trigger)

    def _write(self, timed: DataFrame, batch_id: int) -> None:
        fresh = metrics.tick_counters(timed, self.registry).select("tick", *self.counters, "last_ts")
        sinks.write_version(fresh, f"{self.path}/fresh", batch_id)
        fresh = self.spark.read.parquet(f"{self.path}/fresh/batch_id={batch_id}")
        first_open = self.totals.before(batch_id).agg(F.max("first_open")).scalar()
        is_late = F.coalesce(F.col("tick") < first_open, F.lit(False))
        sinks.write_version(fresh.where(is_late), f"{self.path}/late", batch_id)
        ticks = self._merged(self.ticks.before(batch_id).unionByName(fresh.where(~is_late)))
        newest = ticks.agg(F.max("last_ts")).scalar()
        closes = interval_number(newest - F.make_dt_interval(secs=F.lit(self.delay_s)), METRIC_INTERVAL_S)
        self._close(ticks, F.greatest(closes, first_open), batch_id)
        sinks.remove(self.spark, f"{self.path}/fresh/batch_id={batch_id}")

    def _merged(self, ticks: DataFrame) -> DataFrame:
        return ticks.groupBy("tick").agg(*[F.sum(c).alias(c) for c in self.counters], F.max("last_ts").alias("last_ts"))

    def _close(self, ticks: DataFrame, first_open: Column, batch_id: int) -> None:
        """Read out the ticks before ``first_open`` and add them to the totals."""
        done = F.coalesce(F.col("tick") < first_open, F.lit(False))
        before = self.totals.before(batch_id).agg(
            F.struct(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in self.counters])
        ).scalar()
        # The ticks that close in one batch are a handful of rows.
        so_far = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
        closed = ticks.where(done).select(
            "*", F.col("latency_items").alias("interval_completions"), before.alias("before")
        )
        running = closed.withColumns({c: F.sum(c).over(so_far) + F.col(f"before.{c}") for c in self.counters})
        readings = metrics.tick_readings(running, self.registry)
        sinks.write_version(readings, f"{self.path}/readings", batch_id)
        written = self.spark.read.parquet(f"{self.path}/readings/batch_id={batch_id}")
        sinks.write_lines(metrics.metric_lines(written), f"{self.path}/lines", batch_id)
        totals = self.totals.before(batch_id).select(*self.counters).unionByName(ticks.where(done).select(*self.counters))
        summed = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.counters])
        self.totals.leave(summed.withColumn("first_open", first_open), batch_id)
        self.ticks.leave(ticks.where(~done), batch_id)

    def finish(self, last_batch: int) -> None:
        """Close all ticks, once no more items will come."""
        ticks = self._merged(self.ticks.after(last_batch))
        self._close(ticks, F.lit(2**62), last_batch + 1)

    def readings(self) -> DataFrame:
        """Every reading so far: tick_s, epoch_s, name, value, is_count."""
        return self.spark.read.parquet(f"{self.path}/readings").drop("batch_id")
