"""Stored tables: scan, key lookups, key scan, size, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read a stored table; a given schema replaces inference."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def jdbc_options(
    url: str,
    table: str,
    *,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    splits: int = 64,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options for a JDBC scan, read by many tasks when a split column is given."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if split_column is not None:
        if bounds is None:
            raise ValueError("a split column needs its lower and upper bound")
        low, high = bounds
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(splits),
        }
    return options


def scan_jdbc(spark: SparkSession, schema: T.StructType, **options: str) -> DataFrame:
    """Read a database table and widen single-precision columns to the schema's types."""
    rows = spark.read.format("jdbc").options(**options).load()
    return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def lookup_one(table: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with the given key. The filter reaches the scan if the key is a stored column.

    Where it is derived from one (a padded number, say), give a table that is filtered by the
    stored column first, as ``bank.account`` and ``bank.transactions_of`` do.
    """
    return table.where(F.col(key) == F.lit(value))


def save_for_lookups(rows: DataFrame, path: str, key: str, row_group_bytes: int = 16 * 1024 * 1024) -> None:
    """Store a table for lookups by a key: sorted over all files, in small row groups, with Bloom filters.

    A lookup then reads the footers, and of the data only the row groups that can hold the key.
    """
    ordered = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = ordered.write.mode("overwrite").option("parquet.block.size", str(row_group_bytes))
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def lookup_many(table: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows of ``table`` whose key is asked for in ``wanted``.

    Repeated keys fold before they are shuffled.
    """
    return table.join(_asked(wanted, wanted_key, key), key, "left_semi")


def lookup_missing(table: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Distinct keys asked for that the table does not hold."""
    return _asked(wanted, wanted_key, key).join(table.select(key), key, "left_anti")


def _asked(wanted: DataFrame, wanted_key: str, key: str) -> DataFrame:
    return wanted.select(F.col(wanted_key).alias(key)).where(F.col(key).isNotNull()).distinct()


def keys(table: DataFrame, key: str) -> DataFrame:
    """Only the key column."""
    return table.select(key)


def sizes(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One (table_name, n_rows) row per table."""
    counted = [
        table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, table in tables
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


def append(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to a stored table."""
    rows.write.format(fmt).mode("append").save(path)


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Store a catalog table bucketed by a join key.

    Two tables bucketed alike join without a shuffle, which pays off for accounts
    too many to broadcast.
    """
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
