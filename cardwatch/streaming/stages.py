"""The live flow in three stages, each a stream of its own with the clock it was handled at.

Router, executors and aggregator are separate queries that hand rows over by tables, as
they would run on a cluster. Every stage stamps its rows with the time of the batch that
handled them, so the stamps of an item never decrease and their differences are measured
waiting and working times. What a stage handled is also observed, and comes back with the
progress of its batches (``runs.ProgressLog``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cardwatch.operators import enrich, metrics, verdicts
from cardwatch.operators.rules import Registry
from cardwatch.streaming import flows, runs
from cardwatch.streaming.assembly import Assembly


def clock_ms() -> Column:
    """The time of the batch."""
    return F.unix_millis(F.current_timestamp())


class StagedFlow:
    """The three streams of a registry over one source of transactions, with their tables under ``path``."""

    def __init__(self, spark: SparkSession, merchants: DataFrame, registry: Registry, path: str):
        self.spark, self.merchants, self.registry, self.path = spark, merchants, registry, path
        self.assembly = Assembly(spark, f"{path}/assembly")

    def _table(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.readStream.schema(like.schema).parquet(f"{self.path}/{name}")

    def route(self, transactions: DataFrame, **trigger) -> StreamingQuery:
        """Wrap transactions with the number of sets they go to and the time they were routed."""
        self.routed = flows.envelopes(transactions, self.registry, clock_ms())
        watched = self.routed.observe("router", F.count(F.lit(1)).alias("n_items"))
        return runs.start_to_files(watched, f"{self.path}/routed", f"{self.path}/checkpoint-router", **trigger)

    def execute(self, **trigger) -> StreamingQuery:
        """Post every set's result for the routed items."""
        carriers = self._table("routed", self.routed)
        items = enrich.with_merchant(carriers.select("item.*", "t_routed"), self.merchants)
        results = verdicts.as_rows(verdicts.evaluate(items, self.registry), self.registry, "id", "t_routed")
        # An item's time to live begins when it is routed.
        self.posted = results.withColumnRenamed("id", "item_id").withColumns({
            "ts": F.timestamp_millis("t_routed"), "posted_ms": clock_ms(),
        })
        watched = self.posted.observe("executors", F.count(F.lit(1)).alias("n_results"))
        return runs.start_to_files(watched, f"{self.path}/posted", f"{self.path}/checkpoint-executors", **trigger)

    def aggregate(self, **trigger) -> StreamingQuery:
        """Assemble the posted results."""
        posted = self._table("posted", self.posted)
        return runs.start_batches(posted, self.assembly.writer(), f"{self.path}/checkpoint-aggregator", mode="append", **trigger)

    def timed_items(self) -> DataFrame:
        """Finished items with the times of their stages and their latencies."""
        routed = self.spark.read.parquet(f"{self.path}/routed").select("item_id", "t_routed")
        ended = self.assembly.reports().select(
            "item_id", "status", F.col("completed_ms").alias("t_executor"), F.col("reported_ms").alias("t_aggregator")
        )
        return metrics.stage_latencies(ended.join(routed, "item_id"))

    def report(self) -> DataFrame:
        """Items, elapsed time and rate of every set, and of the aggregator with the mean latency."""
        posted = self.spark.read.parquet(f"{self.path}/posted")
        return metrics.stage_report(posted, self.timed_items())
