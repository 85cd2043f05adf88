"""Pending items and their result lists, cleaned up as items finish.

Items are upserted into a pending table and their results appended to a result table.
When all sets that apply to an item have posted, the item is written to the finished table
and deleted from both. Folds drop deleted rows, and a clean-up removes what the folds have
replaced, so the files are bounded by the items that wait.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.sources import sinks


class PendingItems:
    """The tables under ``path``: pending items, their results, finished items."""

    def __init__(self, spark: SparkSession, path: str, fold_every: int = 10, keep: int = 2):
        self.spark, self.path, self.fold_every, self.keep = spark, path, fold_every, keep
        self.pending_path, self.results_path = f"{path}/pending", f"{path}/results"

    def writer(self) -> Callable[[DataFrame, int], None]:
        return self._write

    def _write(self, postings: DataFrame, batch_id: int) -> None:
        """postings: item_id, ts, n_applicable, ruleset, outcome, posted_ms."""
        if batch_id in sinks.snapshot_numbers(self.spark, self.results_path):
            return  # a batch given twice that had got through to its last fold
        for path in (self.pending_path, self.results_path):
            sinks.undo_deletes(self.spark, path, batch_id)
        entries = postings.select("item_id", "ruleset", "posted_ms", "outcome")
        sinks.write_version(entries, self.results_path, batch_id)
        items = postings.groupBy("item_id").agg(F.max("n_applicable").alias("n_applicable"), F.min("ts").alias("ts"))
        sinks.write_version(items, self.pending_path, batch_id)
        # Only items of this batch can have become complete.
        touched = self.spark.read.parquet(f"{self.pending_path}/batch_id={batch_id}")
        results = self.results().join(touched.select("item_id", "n_applicable"), "item_id")
        sets = results.groupBy("item_id", "ruleset").agg(
            F.max("n_applicable").alias("n_applicable"), F.max_by("outcome", F.struct("posted_ms", "outcome")).alias("outcome")
        )
        finished = sets.groupBy("item_id").agg(
            F.max("n_applicable").alias("n_applicable"), F.count(F.lit(1)).cast("int").alias("n_posted"),
            F.array_sort(F.collect_list(F.struct("ruleset", "outcome"))).alias("results"),
        ).where("n_applicable > 0 and n_posted >= n_applicable")
        sinks.write_version(finished, f"{self.path}/finished", batch_id)
        gone = self.spark.read.parquet(f"{self.path}/finished/batch_id={batch_id}").select("item_id")
        for path in (self.pending_path, self.results_path):
            sinks.delete_version(gone, path, batch_id)
        if batch_id % self.fold_every == self.fold_every - 1:
            self.fold(batch_id)

    def fold(self, batch_id: int) -> None:
        sinks.compact(self.spark, self.pending_path, ["item_id"], batch_id)
        sinks.compact_entries(self.spark, self.results_path, ["item_id"], batch_id)
        for path in (self.pending_path, self.results_path):
            sinks.vacuum(self.spark, path, self.keep)

    def pending(self) -> DataFrame:
        """Items that wait for a result."""
        return sinks.read_newest(self.spark, self.pending_path, "item_id")

    def results(self) -> DataFrame:
        """Results of the items that wait, one row each."""
        return sinks.read_entries(self.spark, self.results_path, "item_id").drop("batch_id")

    def finished(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/finished").drop("batch_id")
