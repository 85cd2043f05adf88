"""Keeping the newest rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.fixed_values import IDLE_LIMIT_S

_BUCKET_S = 3600


def not_idle(rows: DataFrame, ts: str, newest: Column | None = None, seconds: int = IDLE_LIMIT_S) -> DataFrame:
    """Rows no older than ``seconds`` before the newest one.

    Rows that cost something to compute should bring the newest time along, from what they
    were computed from; the filter then reaches the scan.
    """
    newest = rows.agg(F.max(ts)).scalar() if newest is None else newest
    return rows.where(F.col(ts) >= newest - F.make_dt_interval(secs=F.lit(seconds)))


def newest(rows: DataFrame, keep: int, ts: str, *tiebreak: Column) -> DataFrame:
    """The ``keep`` newest rows.

    Row counts per hour tell how far back the kept rows can reach, so only those hours are
    sorted. The count pass reads the time, and whatever decides that a row is one of ``rows``.
    """
    hour = F.floor(F.unix_seconds(F.col(ts)) / _BUCKET_S)
    per_hour = rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    newer = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        per_hour.select("hour", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("n_newer"))
        .where(F.col("n_newer") < keep)
        .agg(F.min("hour"))
        .scalar()
    )
    return rows.where(hour >= reach).orderBy(F.desc(ts), *tiebreak).limit(keep)
