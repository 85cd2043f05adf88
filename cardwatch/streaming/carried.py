"""What one micro-batch leaves to the next, as tables in the shared folder.

A batch reads the version its predecessor left and writes its own, so a batch given
twice sees the same input and replaces its own output. Versions no batch can need any
more are removed, so a state's files are bounded by its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from cardwatch.sources import sinks


class Carried:
    """A table under ``path`` that is replaced by every batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _at(self, batch_id: int) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def after(self, batch_id: int) -> DataFrame:
        """The rows a batch left; none before the first."""
        if batch_id < 0:
            return self.spark.createDataFrame([], T.StructType.fromDDL(self.schema))
        return self.spark.read.schema(self.schema).parquet(self._at(batch_id))

    def before(self, batch_id: int) -> DataFrame:
        return self.after(batch_id - 1)

    def leave(self, rows: DataFrame, batch_id: int) -> None:
        """Write what the next batch reads. The version before last goes: only this and the last can be read again."""
        names = T.StructType.fromDDL(self.schema).names
        rows.select(*names).write.mode("overwrite").parquet(self._at(batch_id))
        if batch_id > 1:
            sinks.remove(self.spark, self._at(batch_id - 2))
