"""Replaying a stored transaction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import TRANSACTION_ID_DIGITS
from cardwatch.functions.scalars import padded_id, parsed_id


def row_number_of(transactions: DataFrame) -> Column:
    """Stored ids count up from zero, so the id is the row's position."""
    return parsed_id(transactions["id"], "bigint")


def cyclic(transactions: DataFrame, requested: Column, size: Column) -> DataFrame:
    """``requested`` transactions numbered from zero, reading past the end from the start.

    Number N carries row ``N mod size`` under its own id. Each stored row emits the
    numbers it serves, so the replay is a map over the table without a join.
    """
    row = row_number_of(transactions)
    numbers = F.when(row < requested, F.sequence(row, requested - 1, size))
    others = [c for c in transactions.columns if c != "id"]
    return transactions.select(
        F.explode(numbers).alias("number"), *others
    ).select(padded_id(F.col("number"), TRANSACTION_ID_DIGITS).alias("id"), *others)


def cyclic_by_number(spark: SparkSession, transactions: DataFrame, requested: int, size: int) -> DataFrame:
    """The same replay driven by the numbers: for a small table replayed very often.

    Spreads over the requested numbers instead of over the stored rows.
    """
    stored = transactions.withColumn("row", row_number_of(transactions)).drop("id")
    others = [c for c in transactions.columns if c != "id"]
    numbers = spark.range(requested).select(
        F.col("id").alias("number"), F.pmod(F.col("id"), F.lit(size)).alias("row")
    )
    return numbers.join(stored, "row").select(
        padded_id(F.col("number"), TRANSACTION_ID_DIGITS).alias("id"), *others
    )


def paced(
    spark: SparkSession, transactions: DataFrame, size: int, per_second: int
) -> DataFrame:
    """An endless stream of stored transactions at a steady rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", str(per_second)).load()
    return number_stream(ticks, transactions, size)


def number_stream(ticks: DataFrame, transactions: DataFrame, size: int) -> DataFrame:
    """Give each streamed number the stored row it maps to; ``ts`` is the arrival time."""
    stored = transactions.drop("ts").withColumn("row", row_number_of(transactions)).drop("id")
    numbered = ticks.select(
        F.col("value").alias("number"),
        F.col("timestamp").alias("ts"),
        F.pmod(F.col("value"), F.lit(size)).alias("row"),
    )
    return numbered.join(stored, "row").drop("row").withColumn(
        "id", padded_id(F.col("number"), TRANSACTION_ID_DIGITS)
    ).drop("number")
