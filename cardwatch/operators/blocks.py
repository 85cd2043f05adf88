"""Ordered work over long keys, cut into blocks of the order column.

A window partitioned by key alone puts all of a key's rows in one task. Here the
rows of a key are windowed per block, and only one summary row per block is
carried along the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def with_block(rows: DataFrame, order: str, size: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col(order) / size))


def with_halo(blocked: DataFrame, order: str, size: int, reach: int) -> DataFrame:
    """Copy the last ``reach`` order values of each block into the next one.

    ``is_home`` tells a block's own rows from the copies. ``reach`` must not
    exceed the block size.
    """
    near_end = F.pmod(F.col(order), F.lit(size)) >= size - reach
    home = blocked.withColumnRenamed("block", "home")
    places = F.when(near_end, F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home"))
    spread = home.withColumn("block", F.explode(places))
    return spread.withColumn("is_home", F.col("block") == F.col("home")).drop("home")


def carried(blocked: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Per key and block, the last row of the key's previous block as ``carried``."""
    last = blocked.groupBy(key, "block").agg(
        F.max_by(F.struct(*columns), order).alias("last_row")
    )
    by_key = Window.partitionBy(key).orderBy("block")
    return last.select(key, "block", F.lag("last_row").over(by_key).alias("carried"))


def with_previous(
    rows: DataFrame, key: str, order: str, columns: Sequence[str], size: int | None
) -> DataFrame:
    """Add ``previous``, the key's row before this one by ``order``, as a struct.

    Without a size, rows hold their ``block``; those that lie by key and block aren't shuffled again.
    """
    blocked = rows if size is None else with_block(rows, order, size)
    inside = Window.partitionBy(key, "block").orderBy(order)
    local = blocked.withColumn("previous_here", F.lag(F.struct(*columns)).over(inside))
    joined = local.join(carried(blocked, key, order, columns), [key, "block"], "left")
    return joined.withColumn("previous", F.coalesce("previous_here", "carried")).drop(
        "previous_here", "carried", "block"
    )


def running_totals(rows: DataFrame, order: str, columns: Sequence[str], size: int) -> DataFrame:
    """Running totals over all rows; one row per block is totalled in a single pass.

    Both sides of the join read the same rows. It is a left join although every
    block matches: an inner join would add a filter to one side only, and the
    rows would be computed twice instead of being exchanged once.
    """
    blocked = with_block(rows, order, size)
    per_block = blocked.groupBy("block").agg(*[F.sum(c).alias(f"block_{c}") for c in columns])
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("block", *[
        F.coalesce(F.sum(f"block_{c}").over(earlier), F.lit(0)).alias(f"before_{c}")
        for c in columns
    ])
    inside = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(offsets, "block", "left").withColumns({
        c: F.sum(c).over(inside) + F.col(f"before_{c}") for c in columns
    }).drop("block", *[f"before_{c}" for c in columns])
