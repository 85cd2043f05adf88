"""Joins that add dimension rows to items.

No join carries a broadcast hint: Catalyst broadcasts a dimension only while its
size is under ``spark.sql.autoBroadcastJoinThreshold``. Above that the join
shuffles, and adaptive execution splits a partition a hot key makes too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.functions import scalars


def _nested(dimension: DataFrame, key: str, name: str) -> DataFrame:
    return dimension.select(
        F.col(key).alias(f"{name}_lookup_key"), F.struct(*dimension.columns).alias(name)
    )


def with_dimension(
    items: DataFrame, dimension: DataFrame, item_key: str, key: str, name: str, how: str = "left"
) -> DataFrame:
    """Add the matching dimension row as a struct column, null when there is none."""
    side = _nested(dimension, key, name)
    lookup_key = f"{name}_lookup_key"
    return items.join(side, items[item_key] == side[lookup_key], how).drop(lookup_key)


def with_merchant(items: DataFrame, merchants: DataFrame) -> DataFrame:
    return with_dimension(items, merchants, "merchant_id", "id", "merchant")


def with_account(items: DataFrame, accounts: DataFrame) -> DataFrame:
    return with_dimension(items, accounts, "acct_number", "acct_number", "account")


def near_last_location(items: DataFrame, accounts: DataFrame) -> DataFrame:
    """Items made near the account's last known city."""
    near = scalars.is_near(items["location"], accounts["location"])
    same_account = items["acct_number"] == accounts["acct_number"]
    return items.join(accounts, same_account & near, "left_semi")


def with_active_rules(items: DataFrame, active: DataFrame, rule_column: str) -> DataFrame:
    """Attach the set of active rule names, read once, to every item.

    The set is one row, so it travels as a scalar subquery and not as a join.
    """
    names = active.agg(F.array_sort(F.collect_set(rule_column))).scalar()
    with_rules = items.withColumn("rules", names)
    return with_rules.withColumn("expected_rules", F.size("rules"))


def pending(items: DataFrame, key: str, finished: DataFrame, finished_key: str) -> DataFrame:
    """Items that have not reached an outcome."""
    return items.join(finished, items[key] == finished[finished_key], "left_anti")
