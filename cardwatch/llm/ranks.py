"""Positions within groups of any size: a range sort, then offsets of its partitions.

A window over a group would bring all its rows into one task. Here the rows are sorted by
range, so a large group lies over many partitions, and only one row per partition and group
is added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.base import stash

_LOCAL = 33  # bits of a generated id that count the rows of a partition


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds place (from 0) in the order within the group, and group_size. group: columns without nulls.

    ``order`` should tell all rows apart; rows it can't tell apart get places in any order.
    The sorted rows are written, so that all readers see the same places.
    """
    keys = [*group, *order]
    ordered = stash(
        rows.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_part", F.shiftright("_at", _LOCAL))
    parts = ordered.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group, "_part", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("group_size"),
    )
    placed = ordered.join(offsets, [*group, "_part"]).withColumn("place", F.expr("_at - _first + _before"))
    return placed.select(*rows.columns, "place", "group_size")


def running_sums(rows: DataFrame, group: Sequence[str], order: str, columns: Sequence[str], block: int = 4096) -> DataFrame:
    """Each column summed from the group's first row up to this one. order: whole numbers from 0, each once a group.

    Blocks of the order are summed apart; along a group only one row per block is added up.
    """
    blocked = rows.withColumn("_block", F.expr(f"{order} div {block}"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy(*group, "_block").agg(*[F.sum(c).alias(f"_of_{c}") for c in columns]).select(
        *group, "_block", *[F.coalesce(F.sum(f"_of_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns]
    )
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.join(offsets, [*group, "_block"]).withColumns(
        {c: F.sum(c).over(inside) + F.col(f"_before_{c}") for c in columns}
    )
    return summed.select(*rows.columns)
