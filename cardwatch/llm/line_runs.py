"""Line deduplication over levelled sorted runs of line hashes.

A run holds each line hash once, with the number of documents that hold the line and the
largest of their ids. Runs are tables bucketed and sorted by the hash. A new batch folds its
lines, meets the runs in a merge anti-join (which tells the lines no run knows yet), and is
written as a run of its own; ``seen`` marks what an earlier run knows. When a level holds
``fan_out`` runs they are merged into one of the next level, so a batch meets few runs and a
hash is rewritten once a level. Only hashes with ``seen`` rows, or enough documents in one row,
can qualify; all others are read once more and never shuffled again.

Which lines go is known after the last batch, so the lines' places are kept beside the runs
and joined with the hashes that qualify. Hot lines fold before every shuffle, and the join
is one adaptive execution can split. Hashes have 128 bits; apart from their collisions the
result is exact.

Defined cases. A null or empty text is one empty line and stays as it is. A null id is less
than all others, and all rows without id count as one document. Rows of one id are one
document: none of its lines is dropped in favour of another row of the same id. An empty
table gives no rows. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.llm.base import scratch, stash
from cardwatch.llm.ranks import partitions

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_OUT = 2
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _LOWER)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def line_places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, place and hash (h1, h2) of every line that is long enough."""
    lines = _texts(docs).select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The runs of one store, in a folder every executor reaches."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[str]] = []

    def _save(self, rows: DataFrame) -> str:
        """Rows as a table bucketed and sorted by hash, one file a bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(partitions(rows), *_HASH).sortBy(*_HASH)
        writer.option("path", scratch(self.spark, "line-run")).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def marked(self, lines: DataFrame) -> DataFrame:
        """Hashes with ``seen``: whether some run knows them. lines: one row a hash."""
        fresh = lines.withColumn("seen", F.lit(False))
        for run in self.runs():
            known = run.where(~F.col("seen")).select(*_HASH, F.lit(True).alias("known"))
            joined = fresh.join(known, _HASH, "left")
            fresh = joined.withColumn("seen", F.col("seen") | F.coalesce("known", F.lit(False))).drop("known")
        return fresh

    def add(self, places: DataFrame) -> None:
        """A batch's lines as a new run. No document may be in two batches."""
        in_documents = places.select("doc_id", *_HASH).distinct()
        counts = in_documents.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
        name = self._save(self.marked(counts))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_out:
            merged = _folded(_union([self.spark.table(name) for name in self.levels[level]]))
            name = self._save(merged)
            if level + 1 == len(self.levels):
                self.levels.append([])
            self._forget(self.levels[level])
            self.levels[level] = []
            self.levels[level + 1].append(name)
            level += 1

    def shared_lines(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Hashes held by enough documents, with the largest id (null if none of them has one)."""
        runs = self.runs()
        again = _union([r.where("seen").select(*_HASH) for r in runs]).distinct()
        settled = F.col("seen") | (F.col("n_docs") >= min_docs)
        found = [r.where(settled) for r in runs] + [r.where(~settled).join(again, _HASH, "left_semi") for r in runs]
        return _folded(_union(found)).where(F.col("n_docs") >= min_docs).select(*_HASH, "top_doc")

    def _forget(self, names: list[str]) -> None:
        """Take runs out of the session's catalog; their files stay for readers."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)
        self.levels = []


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _folded(rows: DataFrame) -> DataFrame:
    """One row a hash; it stays ``seen`` only if the row that was new isn't among them."""
    return rows.groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"), F.bool_and("seen").alias("seen"))


def _without(lines: str, places: str) -> str:
    """SQL for a list without the entries at the places (ascending, from 0): the stretches between them."""
    starts = f"concat(array(0), transform({places}, p -> p + 1))"
    ends = f"concat({places}, array(size({lines})))"
    return f"flatten(zip_with({starts}, {ends}, (a, b) -> slice({lines}, a + 1, b - a)))"


def drop_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_out: int = FAN_OUT
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text left of every document.

    A line of enough characters that enough documents hold stays only in the largest id of
    them. The documents come in as that many batches, told by the hash of the id; the rows
    don't depend on how many.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    path = scratch(spark, "line-places")
    line_places(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "doc_id long, text_hash long, place int, h1 long, h2 long, batch int"
    places = spark.read.schema(schema).parquet(path)
    store = LineRuns(spark, fan_out)
    for number in range(batches):
        store.add(places.where(F.col("batch") == number))
    shared = stash(store.shared_lines(min_docs), "shared-lines")
    store.close()
    later = F.coalesce(F.col("doc_id") < F.col("top_doc"), F.lit(True))
    gone = (
        places.join(shared, _HASH).where(later)
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
        .agg(F.array_sort(F.collect_set("place")).alias("gone"))
    )
    texts = _texts(docs)
    joined = texts.join(gone, texts["doc_id"].eqNullSafe(gone["gone_id"]) & (texts["text_hash"] == gone["gone_hash"]), "left")
    kept = F.expr(f"array_join({_without('lines', 'gone')}, '\\n')")
    return joined.withColumn("lines", F.split("text", "\n")).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
