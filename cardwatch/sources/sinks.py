"""Writers: outcome tables, versioned upserts, metric text, errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def write_outcomes(verdicts: DataFrame, path: str, mode: str = "append") -> None:
    """One table partitioned by outcome, so each outcome reads as its own table."""
    verdicts.write.mode(mode).partitionBy("final_status").parquet(path)


def read_outcome(spark: SparkSession, path: str, status: str, schema: T.StructType | None = None) -> DataFrame:
    """One outcome's table; a given schema serves a table that may be empty."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).where(F.col("final_status") == status)


def history(*outcomes: DataFrame) -> DataFrame:
    """Several outcome tables as one."""
    result = outcomes[0]
    for table in outcomes[1:]:
        result = result.unionByName(table)
    return result


def write_version(rows: DataFrame, path: str, batch_id: int) -> None:
    """Store a batch's rows under its number; a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def newest_per_key(rows: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """The row with the highest version of each key."""
    values = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*[F.col(v) for v in version]))
    return rows.groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*")


def _numbers(spark: SparkSession, folder: str, prefix: str, mark: str = "") -> list[int]:
    """Numbers of the folders named by a prefix and a number (that hold a mark, if one is named)."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*{mark}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    paths = [f.getPath().getParent() if mark else f.getPath() for f in found]
    return sorted(int(p.getName().removeprefix(prefix)) for p in paths)


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a table, ascending."""
    return _numbers(spark, path, "batch_id=", "/_SUCCESS")


def _unfolded(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest finished snapshot (-1 if none) and the batches after it."""
    snapshot = max(snapshot_numbers(spark, path), default=-1)
    return snapshot, [n for n in _numbers(spark, path, "batch_id=") if n > snapshot]


def snapshot_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots of a table, ascending: the last batch each holds."""
    return _numbers(spark, f"{path}_snapshots", "upto=", "/_SUCCESS")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    snapshot, later = _unfolded(spark, path)
    parts = [spark.read.parquet(f"{path}/batch_id={n}").withColumn("batch_id", F.lit(n).cast("long")) for n in later]
    if snapshot >= 0:
        parts.insert(0, spark.read.parquet(f"{path}_snapshots/upto={snapshot}"))
    return history(*parts)


def delete_version(keys: DataFrame, path: str, batch_id: int) -> None:
    """Delete keys from the table: what they hold up to and including this batch.

    The keys are kept as a version of their own until a fold drops what they delete. A
    later batch may write a key anew; a repeated batch replaces its own deletes.
    """
    keys.distinct().write.mode("overwrite").parquet(f"{path}_deletes/batch_id={batch_id}")


def _deletes(spark: SparkSession, path: str) -> DataFrame | None:
    """Deleted keys with the batch that deleted them, as far as no snapshot has dropped them."""
    snapshot, _ = _unfolded(spark, path)
    parts = [
        spark.read.parquet(f"{path}_deletes/batch_id={n}").withColumn("batch_id", F.lit(n).cast("long"))
        for n in _numbers(spark, f"{path}_deletes", "batch_id=") if n > snapshot
    ]
    return history(*parts) if parts else None


def _newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Each key's newest row with its batch; a delete is the last thing of its batch."""
    rows, deletes = _versions(spark, path), _deletes(spark, path)
    if deletes is None:
        return newest_per_key(rows, list(keys), "batch_id")
    marked = rows.withColumn("deleted", F.lit(False)).unionByName(
        deletes.withColumn("deleted", F.lit(True)), allowMissingColumns=True
    )
    return newest_per_key(marked, list(keys), "batch_id", "deleted").where(~F.col("deleted")).drop("deleted")


def read_newest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The upserted table: each key's row from its newest batch, without deleted keys."""
    return _newest(spark, path, keys).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int) -> None:
    """Fold all versions up to a batch into one row per key; deleted keys go.

    The snapshot counts once its success mark is there, so a fold that breaks off, or a
    batch that is repeated, does no harm. Reads then take the snapshot and the batches
    behind it, so what they read is bounded by the keys and the batches between folds.
    """
    _fold(_newest(spark, path, keys), path, batch_id)


def _fold(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a snapshot; one that is finished holds the same rows already and may be what ``rows`` reads."""
    if batch_id not in snapshot_numbers(rows.sparkSession, path):
        rows.write.mode("overwrite").parquet(f"{path}_snapshots/upto={batch_id}")


# --- appending tables -------------------------------------------------------------

def _entries(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    rows, deletes = _versions(spark, path), _deletes(spark, path)
    if deletes is None:
        return rows
    last = deletes.groupBy(*keys).agg(F.max("batch_id").alias("deleted_by"))
    kept = F.col("deleted_by").isNull() | (F.col("batch_id") > F.col("deleted_by"))
    return rows.join(last, list(keys), "left").where(kept).drop("deleted_by")


def read_entries(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The appending table: every row any batch wrote for a key, with its batch_id.

    An entry belongs to its batch, so a batch given twice appends once. Entries are rows,
    and a key with very many of them stays spread over files.
    """
    return _entries(spark, path, keys)


def read_lists(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], name: str = "entries") -> DataFrame:
    """The appending table as one row per key: its number of entries and their list, sorted by ``order``."""
    entries = _entries(spark, path, keys)
    rest = [c for c in entries.columns if c not in (*keys, *order)]
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"n_{name}"), F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name)
    )


def compact_entries(spark: SparkSession, path: str, keys: Sequence[str], batch_id: int) -> None:
    """Gather the entries of all versions up to a batch, without those of deleted keys.

    The files are evened out by key; a key with very many entries is split.
    """
    _fold(_entries(spark, path, keys).hint("rebalance", *keys), path, batch_id)


# --- summed tables ----------------------------------------------------------------

def read_summed(spark: SparkSession, path: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The table whose versions are parts of sums: each key with its fields added up over all batches."""
    return _versions(spark, path).groupBy(*keys).agg(*[F.sum(f).alias(f) for f in fields])


def compact_summed(spark: SparkSession, path: str, keys: Sequence[str], fields: Sequence[str], batch_id: int) -> None:
    """Fold the parts of all versions up to a batch into one row per key."""
    summed = read_summed(spark, path, keys, fields)
    _fold(summed.withColumn("batch_id", F.lit(batch_id).cast("long")), path, batch_id)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what no reader needs once ``keep`` finished snapshots exist; gives the removed folders.

    The newest ``keep`` snapshots stay, and every version and delete after the oldest of
    them: a reader that began before the last fold still finds all its files. Folds that
    broke off before the newest snapshot go, too.
    """
    finished = snapshot_numbers(spark, path)
    if len(finished) < keep:
        return []
    oldest = finished[-keep]
    kept = set(finished[-keep:])
    gone = [f"{path}_snapshots/upto={n}" for n in _numbers(spark, f"{path}_snapshots", "upto=") if n < finished[-1] and n not in kept]
    for folder in (path, f"{path}_deletes"):
        gone += [f"{folder}/batch_id={n}" for n in _numbers(spark, folder, "batch_id=") if n <= oldest]
    for folder in gone:
        remove(spark, folder)
    return gone


def undo_deletes(spark: SparkSession, path: str, batch_id: int) -> None:
    """Forget what a batch deleted, before it is run again."""
    remove(spark, f"{path}_deletes/batch_id={batch_id}")


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of a table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_lines(lines: DataFrame, path: str, batch_id: int) -> None:
    """Metric lines as text files, one folder per batch."""
    lines.select("line").write.mode("overwrite").text(f"{path}/batch_id={batch_id}")


def with_error(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Name the first failed check of each row; null when none fails."""
    error = F.coalesce(*[
        F.when(F.coalesce(failed, F.lit(False)), F.lit(name)) for name, failed in checks.items()
    ])
    return rows.withColumn("error", error)


def last_errors(failed: DataFrame, component: Column, version: Column) -> DataFrame:
    """The newest error of every component."""
    return failed.where(F.col("error").isNotNull()).groupBy(component.alias("component")).agg(
        F.max_by("error", version).alias("error"), F.count(F.lit(1)).alias("n_errors")
    )
