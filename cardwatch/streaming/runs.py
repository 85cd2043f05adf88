"""Starting streams and reading what they reported."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Keep stream state on disk instead of in executor memory."""
    spark.conf.set(STATE_STORE, ROCKSDB)
    return spark


def stored_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    schema: T.StructType | str,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A stored table as a stream from its oldest row on.

    The table may be one file or a folder of files. A file limit per trigger is
    the back-pressure knob.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    # A one-letter glob: a plain path would have to be a folder.
    return reader.parquet(f"{folder}/{name}.parque[t]")


def broker_stream(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, per_trigger: int
) -> DataFrame:
    """JSON rows of a message topic from the earliest offset, rate limited per trigger."""
    rows = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", str(per_trigger))
        .load()
    )
    return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("value")).select(
        "value.*"
    )


def start_to_files(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stateless stream to a table; the file sink commits each batch once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_batches(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "update",
    **trigger,
) -> StreamingQuery:
    """Hand every micro-batch to ``write``, which must tolerate being given a batch twice."""
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain(query: StreamingQuery) -> StreamingQuery:
    """Wait until everything available has been processed."""
    query.awaitTermination()
    return query


def last_batch(query: StreamingQuery) -> int:
    """Number of the last batch a query ran, -1 if it had none."""
    ran = query.lastProgress
    return ran.batchId if ran is not None else -1


_PROGRESS = (
    "batch_id long, input_rows long, rows_per_second double, batch_ms long, dropped_late_rows long"
)


def _reported(p) -> tuple:
    return (
        p.batchId,
        p.numInputRows,
        float(p.processedRowsPerSecond or 0.0),
        int(p.durationMs.get("triggerExecution", 0)),
        sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
    )


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """What the query reported about its recent batches, one row per batch.

    A query remembers its last batches only; ``ProgressLog`` keeps those of a whole run.
    """
    return spark.createDataFrame([_reported(p) for p in query.recentProgress], _PROGRESS)


class ProgressLog(StreamingQueryListener):
    """Keeps what every batch of the streams of a session reports, in a folder of one text file a batch.

    ``with ProgressLog(spark, folder) as log: ...`` listens while the block runs. A report of a
    batch given twice replaces the one before it. Values named by ``DataFrame.observe`` are kept, too.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        # Events are delivered in the background; those of ended queries are on their way.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        names = [f.split()[0] for f in _PROGRESS.split(", ")]
        observed = {name: row.asDict() for name, row in p.observedMetrics.items()}
        line = json.dumps({"run_id": str(p.runId), **dict(zip(names, _reported(p))), "observed": observed}, default=str)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.runId}-{p.batchId}.json")
        out = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()

    def batches(self, query: StreamingQuery | None = None) -> DataFrame:
        """One row per batch that reported, of one query's run or of all."""
        rows = self.spark.read.schema(f"run_id string, {_PROGRESS}, observed map<string,map<string,string>>").json(f"{self.folder}/*.json")
        return rows if query is None else rows.where(F.col("run_id") == str(query.runId))


def pacing_report(reported: DataFrame, interval_ms: int) -> DataFrame:
    """Batches, how many overran the interval, and their mean overrun."""
    late = F.col("batch_ms") > interval_ms
    return reported.agg(
        F.count(F.lit(1)).alias("batches"),
        F.count(F.when(late, F.lit(1))).alias("overran"),
        F.avg(F.when(late, F.col("batch_ms") - interval_ms)).alias("mean_delay_ms"),
        F.sum("input_rows").alias("input_rows"),
        F.sum("dropped_late_rows").alias("dropped_late_rows"),
    )
