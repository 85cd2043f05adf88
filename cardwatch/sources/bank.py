"""Accounts, merchants and transactions derived from the given star-schema tables.

A deployment that owns real account, merchant and transaction tables reads them
with ``sources.tables.scan`` and the schemas in ``sources.schemas``; everything
downstream only needs those columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import (
    ACCOUNT_ID_DIGITS,
    CITY_GROUPS,
    MERCHANT_ID_DIGITS,
    TRANSACTION_ID_DIGITS,
)
from cardwatch.functions.scalars import padded_id
from cardwatch.sources.schemas import GIVEN
from cardwatch.sources.tables import scan


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", GIVEN[name])


def _city(number: str) -> Column:
    cities = [city for group in CITY_GROUPS for city in group]
    listed = ", ".join(f"'{city}'" for city in cities)
    return F.expr(f"array({listed})[cast({number} % {len(cities)} as int)]")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts_from(given(spark, sf_dir, "customer"))


def account(spark: SparkSession, sf_dir: str, acct_number: str) -> DataFrame:
    """The account of that number; the filter is on the stored key, so it reaches the scan."""
    stored = given(spark, sf_dir, "customer").where(
        F.col("c_custkey") == F.lit(stored_number(acct_number, ACCOUNT_ID_DIGITS))
    )
    return _accounts_from(stored)


def _accounts_from(customers: DataFrame) -> DataFrame:
    number = F.col("c_custkey")
    return customers.select(
        padded_id(number, ACCOUNT_ID_DIGITS).alias("acct_number"),
        (F.lit(1000.0) * (1 + number % 10)).alias("credit_limit"),
        F.col("c_acctbal").alias("balance"),
        (number % 3).cast("short").alias("acct_status"),
        _city("c_custkey").alias("location"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("s_suppkey")
    averages = F.array(F.lit(10.0), F.lit(25.0), F.lit(50.0), F.lit(100.0))
    merchant_id = padded_id(number, MERCHANT_ID_DIGITS)
    return given(spark, sf_dir, "supplier").select(
        merchant_id.alias("id"),
        F.concat(F.lit("Merchant"), merchant_id).alias("name"),
        (number % 11).cast("short").alias("reputation"),
        F.element_at(averages, (number % 4 + 1).cast("int")).alias("avg_txn_amount"),
        _city("s_suppkey").alias("location"),
    )


def transactions_from(events: DataFrame, merchant_count: Column) -> DataFrame:
    """Shape event rows into transactions; works on a stored or a streamed table."""
    number = F.col("event_id")
    merchant_number = F.when(number % 97 != 96, F.pmod(number, merchant_count + 1))
    return events.withColumn("merchant_number", merchant_number).select(
        padded_id(number, TRANSACTION_ID_DIGITS).alias("id"),
        padded_id(F.col("user_id"), ACCOUNT_ID_DIGITS).alias("acct_number"),
        padded_id(F.col("merchant_number"), MERCHANT_ID_DIGITS).alias("merchant_id"),
        F.col("value").alias("amount"),
        _city("event_id").alias("location"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type"),
    )


def merchant_count(spark: SparkSession, sf_dir: str) -> Column:
    """Number of merchants as a one-value subquery, planned with the main query."""
    return given(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()


def stored_number(padded: str, digits: int) -> int | None:
    """The number behind a padded id; None if no stored number is padded to it, so that nothing matches."""
    if not (padded.isascii() and padded.isdigit()) or int(padded) >= 2**63:
        return None
    return int(padded) if str(int(padded)).rjust(digits, "0") == padded else None


def transactions_of(spark: SparkSession, sf_dir: str, acct_number: str) -> DataFrame:
    """The transactions of one account; the filter is on the stored key, so it reaches the scan."""
    number = stored_number(acct_number, ACCOUNT_ID_DIGITS)
    events = given(spark, sf_dir, "events").where(F.col("user_id") == F.lit(number))
    return transactions_from(events, merchant_count(spark, sf_dir))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from(
        given(spark, sf_dir, "events"), merchant_count(spark, sf_dir)
    )
