"""Live averages in event time: payments wait until nothing earlier can come, then are scored.

A payment is scored with the average its merchant had when it was made, whatever the order
in which files arrive. Payments are held until the event time is ``delay_s`` further; a slide
interval that is over by then is final, and its payments are scored with all intervals before.
Payments that arrive for an interval scored already go to a table of late rows. So as long as
files are out of order by less than the delay, the scores are those of one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import AVERAGE_SLIDE_S
from cardwatch.operators import enrich, windows
from cardwatch.functions import scalars
from cardwatch.sources import sinks
from cardwatch.streaming.carried import Carried

_TXN = (
    "id string, acct_number string, merchant_id string, amount double, location string, ts timestamp, event_type string"
)
_SLICES = "merchant_id string, slice long, total double, n long"


def score_live(transactions: DataFrame, slices: DataFrame, merchants: DataFrame) -> DataFrame:
    """Amount risk against the average in force at each payment."""
    live = windows.with_live_average(transactions, slices)
    rows = enrich.with_merchant(live, merchants)
    average = F.when(
        F.col("merchant.id").isNotNull(), F.coalesce("live_average", "merchant.avg_txn_amount")
    )
    risk = F.expr(f"coalesce({scalars.amount_risk('amount', 'average')}, 'LOW')")
    return rows.select("id", "amount", average.alias("average")).select(
        "id", "average", risk.alias("risk")
    )


def still_needed(slices: DataFrame) -> DataFrame:
    """The slices a later payment can still see: the last window's and each merchant's last."""
    newest = slices.agg(F.max("slice")).scalar()
    last = slices.groupBy("merchant_id").agg(F.max("slice").alias("last_slice"))
    recent = F.col("slice") >= newest - windows.SLICES_PER_WINDOW
    marked = slices.join(last, "merchant_id")
    return marked.where(recent | (F.col("slice") == F.col("last_slice"))).drop("last_slice")


class OrderedScoring:
    """The tables of a scoring stream under ``path``: held payments, slices, verdicts and late payments."""

    def __init__(self, spark: SparkSession, merchants: DataFrame, path: str, delay_s: int):
        self.spark, self.merchants, self.path, self.delay_s = spark, merchants, path, delay_s
        self.held = Carried(spark, f"{path}/held", _TXN)
        self.slices = Carried(spark, f"{path}/slices", _SLICES)
        # Intervals before ``final`` are scored; ``newest`` is the latest event time.
        self.clock = Carried(spark, f"{path}/clock", "newest timestamp, final long")

    def writer(self) -> Callable[[DataFrame, int], None]:
        return self._write

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        names = [f.split()[0] for f in _TXN.split(", ")]
        sinks.write_version(batch.select(*names), f"{self.path}/arrived", batch_id)
        arrived = self.spark.read.schema(_TXN).parquet(f"{self.path}/arrived/batch_id={batch_id}")
        before = self.clock.before(batch_id)
        seen = before.select("newest").unionByName(arrived.agg(F.max("ts").alias("newest"))).agg(F.max("newest").alias("newest"))
        final = windows.interval_number(F.col("newest") - F.make_dt_interval(secs=F.lit(self.delay_s)), AVERAGE_SLIDE_S)
        self.clock.leave(seen.select("newest", final.alias("final")), batch_id)
        self._score(arrived, before, self.clock.after(batch_id).agg(F.max("final")).scalar(), batch_id)

    def _score(self, arrived: DataFrame, before: DataFrame, final: Column, batch_id: int) -> None:
        number = windows.interval_number(F.col("ts"), AVERAGE_SLIDE_S)
        late = F.coalesce(number < before.agg(F.max("final")).scalar(), F.lit(False))
        sinks.write_version(arrived.where(late), f"{self.path}/late", batch_id)
        waiting = self.held.before(batch_id).unionByName(arrived.where(~late))
        over = F.coalesce(number < final, F.lit(False))
        ready = waiting.where(over)
        slices = self.slices.before(batch_id).unionByName(windows.merchant_slices(ready)).groupBy("merchant_id", "slice").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n")
        )
        sinks.write_version(score_live(ready, slices, self.merchants), f"{self.path}/verdicts", batch_id)
        self.held.leave(waiting.where(~over), batch_id)
        self.slices.leave(still_needed(slices), batch_id)
        sinks.remove(self.spark, f"{self.path}/arrived/batch_id={batch_id}")

    def finish(self, last_batch: int) -> None:
        """Score what is still held, once no more payments will come."""
        none = self.spark.createDataFrame([], _TXN)
        everything = F.lit(2**62)
        self.clock.leave(self.clock.after(last_batch), last_batch + 1)
        self._score(none, self.clock.after(last_batch), everything, last_batch + 1)

    def verdicts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/verdicts").drop("batch_id")

    def late(self) -> DataFrame:
        return self.spark.read.schema(_TXN).parquet(f"{self.path}/late")
