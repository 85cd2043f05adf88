"""Time-window operators over transactions.

No row is copied to every window it falls in. Amounts are first folded to one
(sum, count) per merchant and slide interval; that fold absorbs a merchant holding
any share of the rows, and everything after it is bounded by merchants times elapsed
intervals. A window's state is then kept up by what enters and what leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.fixed_values import (
    AVERAGE_SLIDE_S,
    AVERAGE_WINDOW_S,
    SIGNIFICANT_CHANGE,
    THROUGHPUT_WINDOW_S,
)
from cardwatch.functions.aggregates import AVERAGE_AMOUNT, Aggregate, exact
from cardwatch.functions.scalars import throughput_text
from cardwatch.operators.blocks import carried, with_block, with_halo, with_previous

SLICES_PER_WINDOW = AVERAGE_WINDOW_S // AVERAGE_SLIDE_S
SLICES_PER_DAY = 86_400 // AVERAGE_SLIDE_S


def interval_number(ts: Column, seconds: int) -> Column:
    """Number of the ``seconds``-long interval since the epoch."""
    return F.floor(F.unix_seconds(ts) / seconds)


def merchant_slices(transactions: DataFrame) -> DataFrame:
    """Sum and count per merchant and slide interval."""
    return transactions.where(F.col("merchant_id").isNotNull()).groupBy(
        "merchant_id", interval_number(F.col("ts"), AVERAGE_SLIDE_S).alias("slice")
    ).agg(F.sum("amount").alias("total"), F.count("amount").alias("n"))


def _average(total: Column, n: Column) -> Column:
    return F.try_divide(total, n)


def sliding_runs(
    slices: DataFrame,
    key: str,
    aggregate: Aggregate,
    reach: int = SLICES_PER_WINDOW,
    block: int = SLICES_PER_DAY,
) -> DataFrame:
    """Runs of sliding windows with the same state: key, ``block``, ``at`` and ``until`` (their first and last
    ``end_slice``), the aggregate's fields. A run ends with its block at the latest.

    slices: key, ``slice``, fields. A slice enters the window that ends behind it and leaves
    ``reach`` windows later, so it makes two changes and not a copy for each of its windows. The
    changes are summed along a key and block (the end of a block is copied into the
    next), and between two changes the window says the same. Of changes at one place, the last has seen all.
    """
    first, last = F.col("block") * block, (F.col("block") + 1) * block - 1
    nearby = with_halo(with_block(slices, "slice", block), "slice", block, reach).repartition(key, "block")
    fields = list(aggregate.fields)
    enters = F.struct(F.greatest(F.col("slice") + 1, first).alias("at"), F.lit(1).alias("held"), *fields)
    leaves = F.struct(
        (F.col("slice") + reach + 1).alias("at"), F.lit(-1).alias("held"), *[(-F.col(f)).alias(f) for f in fields]
    )
    changes = nearby.select(key, "block", F.explode(F.array(enters, leaves)).alias("c")).select(key, "block", "c.*")
    inside = Window.partitionBy(key, "block").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    running = changes.where(F.col("at") <= last).select(
        key, "block", "at", F.coalesce(F.lead("at").over(inside) - 1, last).alias("until"),
        *[F.sum(c).over(so_far).alias(c) for c in ("held", *fields)],
    )
    return running.where("held > 0 and at <= until").select(key, "block", "at", "until", *fields)


def sliding_states(
    slices: DataFrame,
    key: str,
    aggregate: Aggregate,
    reach: int = SLICES_PER_WINDOW,
    block: int = SLICES_PER_DAY,
) -> DataFrame:
    """State of every sliding window that holds a slice: key, ``end_slice`` (exclusive), the aggregate's fields."""
    runs = sliding_runs(slices, key, aggregate, reach, block)
    return runs.select(key, F.explode(F.sequence("at", "until")).alias("end_slice"), *aggregate.fields)


def _exact_slices(slices: DataFrame) -> DataFrame:
    return slices.withColumn("total", F.expr(exact("total")))


def sliding_average(slices: DataFrame) -> DataFrame:
    """Average per merchant for every sliding window that holds a transaction.

    ``window_end_s`` is in epoch seconds and exclusive.
    """
    return sliding_states(_exact_slices(slices), "merchant_id", AVERAGE_AMOUNT).select(
        "merchant_id",
        (F.col("end_slice") * AVERAGE_SLIDE_S).alias("window_end_s"),
        AVERAGE_AMOUNT.finished("avg_amount"),
        F.col("n").alias("n_txns"),
    )


def average_runs(slices: DataFrame) -> DataFrame:
    """``sliding_average`` with only the first window of each run of windows that hold the same, and its ``block``."""
    return sliding_runs(_exact_slices(slices), "merchant_id", AVERAGE_AMOUNT).select(
        "merchant_id",
        "block",
        (F.col("at") * AVERAGE_SLIDE_S).alias("window_end_s"),
        AVERAGE_AMOUNT.finished("avg_amount"),
        F.col("n").alias("n_txns"),
    )


def current_average(slices: DataFrame, now_slice: Column) -> DataFrame:
    """Each merchant's newest window that closed by ``now_slice``.

    A merchant with activity in the last full window has that window. Otherwise
    its newest window is the last one that still held its last active slice, and
    holds nothing else.
    """
    closed = slices.where(F.col("slice") < now_slice).withColumn("now_slice", now_slice)
    recent = F.col("slice") >= F.col("now_slice") - SLICES_PER_WINDOW
    merged = closed.groupBy("merchant_id").agg(
        F.sum(F.when(recent, F.col("total"))).alias("recent_total"),
        F.sum(F.when(recent, F.col("n"))).alias("recent_n"),
        F.max("slice").alias("last_slice"),
        F.max_by("total", "slice").alias("last_total"),
        F.max_by("n", "slice").alias("last_n"),
        F.max("now_slice").alias("now_slice"),
    )
    in_window = F.col("recent_n").isNotNull()
    end = F.when(in_window, F.col("now_slice")).otherwise(F.col("last_slice") + SLICES_PER_WINDOW)
    return merged.select(
        "merchant_id",
        (end * AVERAGE_SLIDE_S).alias("window_end_s"),
        F.when(in_window, _average(F.col("recent_total"), F.col("recent_n")))
        .otherwise(_average(F.col("last_total"), F.col("last_n"))).alias("avg_amount"),
    )


def updated_merchants(merchants: DataFrame, averages: DataFrame) -> DataFrame:
    """Merchant rows carrying their newest average; merchants without one are left out."""
    joined = merchants.join(averages, merchants["id"] == averages["merchant_id"], "inner")
    columns = [
        F.col("avg_amount").alias(c) if c == "avg_txn_amount" else merchants[c]
        for c in merchants.columns
    ]
    return joined.select(*columns, "window_end_s")


def average_before(slices: DataFrame) -> DataFrame:
    """For every active slice of a merchant, the average in force when it starts.

    The window closing as the slice starts covers the slices just before it; when
    those are all empty, the previous active slice alone made up the newest window.
    Both look-backs run per merchant and day, so no merchant fills one task.
    """
    sums = ["total", "n"]
    blocked = with_block(slices, "slice", SLICES_PER_DAY)
    nearby = with_halo(blocked, "slice", SLICES_PER_DAY, SLICES_PER_WINDOW)
    inside = Window.partitionBy("merchant_id", "block").orderBy("slice")
    before = inside.rangeBetween(-SLICES_PER_WINDOW, -1)
    looked_back = nearby.withColumns({
        "recent": _average(F.sum("total").over(before), F.sum("n").over(before)),
        "previous": F.lag(F.struct(*sums)).over(inside),
    }).where("is_home")
    joined = looked_back.join(
        carried(blocked, "merchant_id", "slice", sums), ["merchant_id", "block"], "left"
    ).withColumn("last", F.coalesce("previous", "carried"))
    return joined.select(
        "merchant_id",
        "slice",
        F.coalesce("recent", _average(F.col("last.total"), F.col("last.n"))).alias("live_average"),
    )


def with_live_average(transactions: DataFrame, slices: DataFrame) -> DataFrame:
    """Give every transaction the average its merchant had when it arrived.

    Joins on (merchant, slice), so a hot merchant spreads over its slices.
    """
    live = average_before(slices)
    rows = transactions.withColumn("slice", interval_number(F.col("ts"), AVERAGE_SLIDE_S))
    return rows.join(live, ["merchant_id", "slice"], "left").drop("slice")


def average_changes(averages: DataFrame, merchants: DataFrame) -> DataFrame:
    """Windows whose average moved by more than the significant amount.

    A merchant's first window compares with its stored average. Windows that say the same as
    the one before don't matter, so ``average_runs`` will do in place of all windows, with a
    tenth of the rows; its ``block`` (the day) is used as it is.
    """
    stored = merchants.select(F.col("id").alias("merchant_id"), "avg_txn_amount")
    previous = with_previous(
        averages, "merchant_id", "window_end_s", ["avg_amount"], None if "block" in averages.columns else AVERAGE_SLIDE_S * SLICES_PER_DAY
    )
    compared = previous.join(stored, "merchant_id").select(
        "merchant_id",
        "window_end_s",
        F.coalesce("previous.avg_amount", "avg_txn_amount").alias("old_average"),
        F.col("avg_amount").alias("new_average"),
    )
    moved = F.abs(F.col("new_average") - F.col("old_average"))
    # Nine digits: averages that differ by exactly the limit agree, however they were summed.
    return compared.where(F.round(moved, 9) > SIGNIFICANT_CHANGE)


def tumbling_counts(items: DataFrame, seconds: int = THROUGHPUT_WINDOW_S) -> DataFrame:
    """Items per tumbling window, with the whole-number rate as text."""
    return (
        items.groupBy(F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_items"))
        .select(
            F.unix_seconds(F.col("w.end")).alias("window_end_s"),
            "n_items",
            throughput_text(F.col("n_items"), seconds).alias("tps"),
        )
    )
