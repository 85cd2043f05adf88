"""Benchmark decontamination by an FM-index of every training shard.

Test phrases are the windows of ``WINDOW`` words of every benchmark item (an item of
fewer words is one phrase). Each shard of documents becomes an FM-index over the numbers
of benchmark words. Words no benchmark item has stand as separators, and stretches too
short for the shortest phrase are left out, since nothing can match there. Backward
search finds all phrases at once, sampled suffix positions locate them, and their word
ranges merge into removal spans.

Benchmark items are read in blocks of at most ``BLOCK_CHARS`` characters, so what is
broadcast has a fixed bound whatever the benchmark's size. With more than one block the
documents are written once with a key for each row, every block is a pass over them, and
the spans of all passes are merged by that key, so rows are the same as with one block.

Defined cases: a null or empty text has no words, no hits and is clean; a null or empty
benchmark text gives no phrase; without phrases nothing is contaminated. Repeated
documents give repeated rows, and each row is judged by its own text, whatever its id.
Repeated items count by distinct id; an item without id is matched but not counted.
Further columns of either input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import alnum_words, lean, stash
from cardwatch.llm.fm_index import FMIndex

WINDOW = 13
BLOCK_CHARS = 4_000_000
SHARD_WORDS = 100_000

SCHEMA = (
    "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
)
N_HIT = "aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """(item id, text) lists of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def phrases(items: list[tuple], window: int = WINDOW) -> dict:
    """Vocabulary and distinct phrases, each stored from its end, with the items that have it."""
    vocabulary: dict[bytes, int] = {}
    of: dict[tuple, set] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)]
        for k in range(max(1, len(ids) - window + 1) if ids else 0):
            of.setdefault(tuple(ids[k : k + window]), set()).add(item)
    lengths = np.array([len(p) for p in of], np.int64)
    rows = np.zeros((len(of), window), np.int64)
    for k, phrase in enumerate(of):
        rows[k, : len(phrase)] = phrase[::-1]
    return {
        "vocabulary": vocabulary,
        "rows": rows,
        "lengths": lengths,
        "items": [sorted(x for x in found if x is not None) for found in of.values()],
    }


def _shard_hits(words: list[list[bytes]], known: dict) -> tuple[list[list[tuple]], list[set]]:
    """Merged spans and item ids of each document of a shard."""
    spans: list[list[tuple]] = [[] for _ in words]
    items: list[set] = [set() for _ in words]
    get, lengths = known["vocabulary"].get, known["lengths"]
    if not len(lengths):
        return spans, items
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    symbols = np.zeros(int(starts[-1]), np.int64)
    for k, w in enumerate(words):
        symbols[starts[k] : starts[k] + len(w)] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
    # Stretches of benchmark words that are long enough, each with the separator behind it.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], symbols > 0, [0]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= lengths.min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return spans, items
    size = end - begin + 1
    offset = np.concatenate([[0], np.cumsum(size)])
    origin = np.repeat(begin - offset[:-1], size) + np.arange(int(offset[-1]))
    index = FMIndex(symbols[origin], len(known["vocabulary"]))
    which, low, high = index.search(known["rows"], known["lengths"])
    times = high - low
    if not len(which) or not times.sum():
        return spans, items
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
    which = np.repeat(which, times)
    place = origin[index.locate(rows)]
    covered = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + lengths[which], -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(covered) > 0, [0]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        k = int(np.searchsorted(starts, a, "right")) - 1
        spans[k].append((int(a - starts[k]), int(b - starts[k])))
    docs = np.searchsorted(starts, place, "right") - 1
    for k, phrase in set(zip(docs.tolist(), which.tolist(), strict=True)):
        items[k].update(known["items"][phrase])
    return spans, items


def _shards(batches, column):
    """Lists of (batch, words of its rows), cut where a shard is full."""
    shard, size = [], 0
    for batch in batches:
        words = [alnum_words(text.as_py()) for text in batch.column(column)]
        shard.append((batch, words))
        size += sum(map(len, words))
        if size >= SHARD_WORDS:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def _scan(known):
    def run(batches):
        for shard in _shards(batches, 1):
            spans, items = _shard_hits([w for _, words in shard for w in words], known.value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0) for batch, _ in shard]),
                    pa.array([len(w) for _, words in shard for w in words], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return lean(run)


def _keep(known, column):
    def run(batches):
        for shard in _shards(batches, column):
            spans, _ = _shard_hits([w for _, words in shard for w in words], known.value)
            hits, k = [sum(b - a for a, b in s) for s in spans], 0
            for batch, words in shard:
                clean = [not (h and 20 * h >= len(w)) for h, w in zip(hits[k : k + len(words)], words, strict=True)]
                k += len(words)
                yield batch.filter(pa.array(clean, pa.bool_()))

    return lean(run)


def _merged(docs: DataFrame, blocks: Iterator[list[tuple]]) -> DataFrame:
    """doc_id (here a key that no two rows share), n_words, spans and items over all blocks."""
    sc = docs.sparkSession.sparkContext
    found = None
    for block in blocks:
        one = docs.mapInArrow(_scan(sc.broadcast(phrases(block))), SCHEMA)
        # The first pass keeps a row for every document.
        found = one if found is None else found.unionByName(one.where("size(spans) > 0"))
    gathered = found.groupBy("doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = """aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) ->
        if(size(a) > 0 and element_at(a, -1).end >= s.start,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, s.end) as end))),
           concat(a, array(s))))"""
    return gathered.select("doc_id", "n_words", F.expr(merged).alias("spans"), "items")


def _keyed(documents: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written with a key for each row, and the key's name."""
    key = "_row"
    while key in documents.columns:
        key = "_" + key
    return stash(documents.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[list[tuple], Iterator[list[tuple]] | None]:
    """The first block, and all of them if there are more."""
    blocks = item_blocks(benchmark, block_chars)
    first, second = next(blocks), next(blocks, None)
    return first, None if second is None else chain((first, second), blocks)


def removal_spans(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, merged word spans (end exclusive) to remove, and the items found."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, blocks = _blocks(benchmark, block_chars)
    if blocks is None:
        return docs.mapInArrow(_scan(documents.sparkSession.sparkContext.broadcast(phrases(first))), SCHEMA)
    keyed, key = _keyed(docs)
    found = _merged(keyed.select(F.col(key).alias("doc_id"), "text"), blocks).withColumnRenamed("doc_id", "_found")
    return keyed.select("doc_id", key).join(found, F.col(key) == F.col("_found")).select("doc_id", "n_words", "spans", "items")


def _verdict(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: words, hit words, items with an occurring phrase, and the verdict."""
    n_hit = F.expr(N_HIT)
    return removal_spans(documents, benchmark, block_chars).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        _verdict(n_hit).alias("contaminated"),
        "spans",
    )


def clean_rows(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that are not contaminated, unchanged.

    With one block of items the rows are filtered where they lie. With more, hits of all
    blocks are added up first and contaminated rows leave by a join on their key.
    """
    first, blocks = _blocks(benchmark, block_chars)
    if blocks is None:
        known = documents.sparkSession.sparkContext.broadcast(phrases(first))
        return documents.mapInArrow(_keep(known, documents.columns.index("text")), documents.schema)
    keyed, key = _keyed(documents)
    found = _merged(keyed.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), blocks)
    hit = stash(found.where(_verdict(F.expr(N_HIT))).select(F.col("doc_id").alias("_hit")), "contaminated")
    return keyed.join(hit, F.col(key) == F.col("_hit"), "left_anti").select(*documents.columns)
