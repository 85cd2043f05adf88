"""Shared helpers: tables, the shared working folder, words of a text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Rows of one Arrow batch. Texts of 100,000 characters then make batches of 25 MB.
BATCH_ROWS = 256

# Whether the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bytes of words made of letters, digits and everything beyond ASCII, lower-cased.
_ALNUM = bytes(
    c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share.

    It lies under ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder, and keeps it for its further calls.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="cardwatch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/cardwatch-llm/{purpose}-{uuid.uuid4().hex}"


def stash(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of df from a table in the shared folder, where a lost executor takes nothing along.

    Later steps read the table, so the write's shuffle files go as soon as it ends. Spark would
    keep them until the driver next collects garbage, which with few objects is late.
    """
    spark = df.sparkSession
    path = scratch(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives memory back when its task ends; worker processes live on."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; none of a null."""
    return text.encode().lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none of a null."""
    return text.encode().translate(_ALNUM).split() if text else []
