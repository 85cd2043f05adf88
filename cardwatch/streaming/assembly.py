"""Assembly of posted results that lets go of finished items.

Results of an item are posted by its rule sets, over any number of batches. An item is
COMPLETE as soon as as many sets have posted as apply to it, and TIMED_OUT when its time to live
is over first. Either way it is reported once, with the whole result of every set, and
leaves the state. So the state is the open items, however long the stream runs.

What is reported follows from the times in the data and not from the batches:

* an item completes when the set that was still missing posts its first result; of each
  set the newest result up to then counts;
* results posted later than the time to live after the item's event time don't count;
* an item times out when the newest event time seen is past the end of its life.

Results for items that are finished already are written beside, as late. To know them the
ids of finished items are kept until their time to live is over; what comes even later is
told by its event time. Rows that arrive further behind than the time to live are late in
any case, so files may be out of order by that much.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import IDLE_LIMIT_S
from cardwatch.sources import sinks
from cardwatch.streaming.carried import Carried

COMPLETE, TIMED_OUT = "COMPLETE", "TIMED_OUT"
# What a rule set may post, the newest first by time and then by registration.
RESULT = {"posted_ms": "bigint", "ordinal": "int", "outcome": "string", "reason": "string", "result_double": "double", "result_risk": "string"}
_RESULT = "struct<" + ",".join(f"{name}:{kind}" for name, kind in RESULT.items()) + ">"
_OPEN = f"item_id string, ts timestamp, n_applicable int, results array<struct<ruleset:string,first_ms:bigint,result:{_RESULT}>>"


def posted_rows(postings: DataFrame) -> DataFrame:
    """Posted results with all fields a result may have; those a flow doesn't post are null."""
    have = [(F.col(c) if c in postings.columns else F.lit(None)).cast(kind).alias(c) for c, kind in RESULT.items()]
    return postings.select("item_id", "ts", "n_applicable", "ruleset", F.col("posted_ms").alias("first_ms"), F.struct(*have).alias("result"))


def in_time(rows: DataFrame, ttl_s: int) -> DataFrame:
    """Results posted within their item's time to live."""
    return rows.where(F.col("result.posted_ms") <= F.unix_millis("ts") + ttl_s * 1000)


def assembled(rows: DataFrame) -> DataFrame:
    """One row per item: n_posted, when it completed (null if open) and each set's result up to then.

    rows: item_id, ts, n_applicable, ruleset, first_ms (first post of the set) and result.
    Repeats of a set fold before they are shuffled; lists hold one entry a set.
    """
    sets = rows.groupBy("item_id", "ruleset").agg(
        F.min("first_ms").alias("first_ms"), F.max("n_applicable").alias("n_applicable"), F.min("ts").alias("ts")
    )
    items = sets.groupBy("item_id").agg(
        F.max("n_applicable").alias("n_applicable"), F.min("ts").alias("ts"), F.array_sort(F.collect_list("first_ms")).alias("firsts")
    )
    enough = (F.col("n_applicable") > 0) & (F.size("firsts") >= F.col("n_applicable"))
    items = items.select("item_id", "n_applicable", "ts", F.when(enough, F.expr("firsts[n_applicable - 1]")).alias("completed_ms"))
    counted = rows.drop("n_applicable", "ts").join(items, "item_id").where(
        F.col("completed_ms").isNull() | (F.col("result.posted_ms") <= F.col("completed_ms"))
    )
    newest = counted.groupBy("item_id", "ruleset").agg(
        F.min("first_ms").alias("first_ms"), F.max("result").alias("result"), F.max("n_applicable").alias("n_applicable"),
        F.min("ts").alias("ts"), F.max("completed_ms").alias("completed_ms"),
    )
    return newest.groupBy("item_id").agg(
        F.min("ts").alias("ts"), F.max("n_applicable").alias("n_applicable"), F.count(F.lit(1)).cast("int").alias("n_posted"),
        F.max("completed_ms").alias("completed_ms"), F.array_sort(F.collect_list(F.struct("ruleset", "first_ms", "result"))).alias("results"),
    )


class Assembly:
    """The tables of an assembling stream under ``path``: open items, finished ids, reports, late results."""

    def __init__(self, spark: SparkSession, path: str, ttl_s: int = IDLE_LIMIT_S):
        self.spark, self.path, self.ttl_s = spark, path, ttl_s
        self.open = Carried(spark, f"{path}/open", _OPEN)
        self.finished_ids = Carried(spark, f"{path}/finished_ids", "item_id string, ts timestamp")
        self.clock = Carried(spark, f"{path}/clock", "newest timestamp")

    def writer(self) -> Callable[[DataFrame, int], None]:
        return self._write

    def _write(self, postings: DataFrame, batch_id: int) -> None:
        # The batch is computed once; all that follows reads what it wrote.
        sinks.write_version(posted_rows(postings), f"{self.path}/posted", batch_id)
        known = self.spark.read.parquet(f"{self.path}/posted/batch_id={batch_id}")
        clock_before = self.clock.before(batch_id).agg(F.max("newest")).scalar()
        seen = self.clock.before(batch_id).unionByName(known.agg(F.max("ts").alias("newest")))
        self.clock.leave(seen.agg(F.max("newest").alias("newest")), batch_id)
        now = self.clock.after(batch_id).agg(F.max("newest")).scalar()
        life = F.make_dt_interval(secs=F.lit(self.ttl_s))

        closed = self.finished_ids.before(batch_id).select("item_id").withColumn("closed", F.lit(True))
        over = F.coalesce(F.col("ts") + life < clock_before, F.lit(False))
        told = known.join(closed, "item_id", "left").withColumn("late", F.coalesce("closed", F.lit(False)) | over).drop("closed")
        late = told.where(F.col("late") | (F.col("result.posted_ms") > F.unix_millis("ts") + self.ttl_s * 1000))
        sinks.write_version(late.select("item_id", "ts", "ruleset", "result.*"), f"{self.path}/late", batch_id)

        waiting = self.open.before(batch_id).select("item_id", "ts", "n_applicable", F.inline("results"))
        fresh = in_time(told.where(~F.col("late")).drop("late"), self.ttl_s)
        items = assembled(waiting.unionByName(fresh)).withColumn(
            "status",
            F.when(F.col("completed_ms").isNotNull(), F.lit(COMPLETE)).when(F.col("ts") + life < now, F.lit(TIMED_OUT)),
        )
        sinks.write_version(items, f"{self.path}/items", batch_id)
        items = self.spark.read.parquet(f"{self.path}/items/batch_id={batch_id}")
        reported = items.where(F.col("status").isNotNull()).withColumn("reported_ms", F.unix_millis(F.current_timestamp()))
        sinks.write_version(reported, f"{self.path}/reports", batch_id)
        self.open.leave(items.where(F.col("status").isNull()), batch_id)
        ids = self.finished_ids.before(batch_id).unionByName(reported.select("item_id", "ts"))
        self.finished_ids.leave(ids.where(F.col("ts") + life >= now), batch_id)
        for worked in ("posted", "items"):
            sinks.remove(self.spark, f"{self.path}/{worked}/batch_id={batch_id}")

    def reports(self) -> DataFrame:
        """Every finished item once: ts, n_applicable, n_posted, completed_ms, results, status, and when it was reported."""
        return self.spark.read.parquet(f"{self.path}/reports").drop("batch_id")

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/late").drop("batch_id")
