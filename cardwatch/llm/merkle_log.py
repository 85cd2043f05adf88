"""Merkle manifest of a table: a hash tree per source, kept as a postorder append log.

Leaves of a source are put in order and cut into aligned spans of 256. A builder takes one
span and appends a node to its log as soon as the node is complete, so children come before
their parent (postorder). The roots of 256 spans are the input of a builder of the next
round, until one root is left. The position of a node follows from the sizes of the subtrees
before it (``position``), so a proof is read from the log by addressing siblings; no pointer
is stored. Proofs go down the rounds again: a builder hands each of its inputs the siblings on
the way up, so no node is looked up by all leaves of a source. The roots of all sources are
leaves of one more tree, built alike.

No task holds more than a span and its path, however large a source is. Every round is
written to the shared folder, 256 times smaller than the one before.

Defined cases. A null column enters a leaf as ``-``; a null source is a source of its own,
before all others. Rows without an id come first in their source and are never tampered with.
Rows of one id are in order of their leaves; repeated rows have equal leaves, and each has its
own proof. An empty text is a value of no bytes. An empty table gives no rows. Columns beyond
the five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.llm.base import lean, stash
from cardwatch.llm.ranks import ranked

FAN = 16
# Inputs of one builder: two levels of the tree.
SPAN = FAN * FAN
DIGEST = 32
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- the shape of a tree ----------------------------------------------------------

def level_counts(n: int, height: int) -> list[int]:
    """Nodes of each level over n inputs."""
    return [-(-n // FAN**level) for level in range(height + 1)]


def tree_height(n: int) -> int:
    """Levels above n inputs until one node remains."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def position(level: int, number: int, n: int, height: int) -> int:
    """Place in the postorder log of node ``number`` of a level, in a tree of that height over n inputs.

    All nodes up to its level whose inputs end no later are before it or itself, and of
    higher levels those whose last input comes before its first.
    """
    done = sum(min((number + 1) * FAN ** (level - low), count) for low, count in enumerate(level_counts(n, level)))
    return done + sum(number // FAN ** (high - level) for high in range(level + 1, height + 1)) - 1


def span_height(block: int, n: int) -> tuple[int, int]:
    """Inputs and levels of the builder of a span, in a round of n inputs."""
    inputs = min(SPAN, n - block * SPAN)
    return inputs, 2 if n > SPAN else tree_height(n)


# --- building -------------------------------------------------------------------

def node_of(children: Sequence[bytes]) -> bytes:
    """The digest of children written one after the other, each as lowercase hex."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def append(inputs: Sequence[bytes], height: int) -> list[bytes]:
    """The log of a builder: its nodes in order of completion."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    def put(level: int, node: bytes) -> None:
        log.append(node)
        if level < height:
            open_runs[level].append(node)
            if len(open_runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        put(level + 1, node_of(run))

    for node in inputs:
        put(0, node)
    for level in range(height):  # runs that ended early
        if open_runs[level]:
            close(level)
    return log


def at(log: bytes, place: int) -> bytes:
    return log[place * DIGEST : (place + 1) * DIGEST]


def way_up(log: bytes, number: int, inputs: int, height: int) -> list[tuple[int, bytes]]:
    """For input ``number`` of a span: its place in its run and that run's digests, level by level."""
    path = []
    for level, count in enumerate(level_counts(inputs, height)[:height]):
        run = number // FAN
        members = range(run * FAN, min((run + 1) * FAN, count))
        path.append((number % FAN, b"".join(at(log, position(level, m, inputs, height)) for m in members)))
        number = run
    return path


def siblings(path: Sequence[tuple[int, bytes]]) -> bytes:
    """The digests beside the path, level by level, left to right."""
    return b"".join(run[: place * DIGEST] + run[(place + 1) * DIGEST :] for place, run in path)


def folded(node: bytes, path: Sequence[tuple[int, bytes]]) -> bytes:
    """The root that a node and its siblings lead to."""
    for place, run in path:
        node = node_of([run[: place * DIGEST], node, run[(place + 1) * DIGEST :]])
    return node


# --- Spark ------------------------------------------------------------------------

_PATH = "path array<struct<place:int,run:binary>>"


def _leaf(columns: dict[str, Column]) -> Column:
    texts = [columns[c].cast("string") for c in LEAF_COLUMNS]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source as a sortable key), doc_id, node, and the tampered leaf of every fifth id's rows."""
    columns = {c: docs[c] for c in LEAF_COLUMNS}
    lowered = columns | {"text": F.translate(docs["text"], _UPPER, _LOWER)}
    fifth = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(5)) == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("")).alias("tree"),
        docs["doc_id"].cast("long").alias("doc_id"),
        _leaf(columns).alias("node"),
        F.when(fifth, _leaf(lowered)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )


def _build(items: DataFrame, round_size: str) -> DataFrame:
    """One row a span: tree, size (leaves of the tree), block, round_size, items and the log of its builder."""
    item = F.struct("place", *[c for c in items.columns if c not in ("tree", "size", "place")])
    spans = items.groupBy("tree", F.expr(f"place div {SPAN}").alias("block")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(item)).alias("items")
    )
    spans = spans.select("tree", "size", "block", F.expr(round_size).alias("round_size"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            nodes, ends = lists.flatten().field("node").to_pylist(), lists.value_lengths().to_pylist()
            logs, start = [], 0
            for block, size, count in zip(batch.column("block").to_pylist(), batch.column("round_size").to_pylist(), ends):
                inputs, height = span_height(block, size)
                assert inputs == count
                logs.append(b"".join(append(nodes[start : start + count], height)))
                start += count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.binary())], [*batch.schema.names, "log"])

    return spans.mapInArrow(lean(run), T.StructType([*spans.schema.fields, T.StructField("log", T.BinaryType())]))


def build(placed: DataFrame) -> list[DataFrame]:
    """The rounds of all trees, from the leaves up. placed: tree, size, place, node and what the leaves carry along."""
    rounds = [stash(_build(placed, "size"), "merkle")]
    most = rounds[0].agg(F.max("size")).first()[0] or 0
    while most > SPAN:
        most = -(-most // SPAN)
        below = rounds[-1].where(f"round_size > {SPAN}")
        inputs = below.select("tree", "size", F.col("block").alias("place"), F.expr(f"substring(log, -{DIGEST})").alias("node"))
        rounds.append(stash(_build(inputs, _sized(len(rounds))), "merkle"))
    return rounds


def _sized(round_number: int) -> str:
    """Inputs of a tree in a later round."""
    text = "size"
    for _ in range(round_number):
        text = f"({text} + {SPAN - 1}) div {SPAN}"
    return text


def tree_roots(rounds: Sequence[DataFrame]) -> DataFrame:
    """tree, node: the last node of each tree's last builder."""
    found = [r.where(f"round_size <= {SPAN}").selectExpr("tree", f"substring(log, -{DIGEST}) as node") for r in rounds]
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


# What becomes of a span's inputs: (columns of the span, fields of its items, nodes, paths) -> arrays.
Finish = Callable[[dict, pa.StructArray, list[bytes], list[list[tuple[int, bytes]]]], list[pa.Array]]
_PATH_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.binary())]))


def _ways(spans: DataFrame, carried: str, finish: Finish, schema: str) -> DataFrame:
    """A row for each input of the spans, made from its node and its path: its way up in its span, then the span's own.

    spans: a round with path and subroot. carried: fields of the items to give along, in SQL.
    """
    listed = spans.select(
        "tree", "block", "round_size", "log", "subroot", "path", F.expr(f"transform(items, i -> named_struct({carried}))").alias("items")
    )
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for place in range(whole.num_rows):  # a span makes one batch: paths are much longer than leaves
                items = whole.column("items").slice(place, 1).flatten()
                row = whole.drop_columns(["items"]).slice(place, 1).to_pylist()[0]
                inputs, height = span_height(row["block"], row["round_size"])
                above = [(step["place"], step["run"]) for step in row["path"]]
                ways = [way_up(row["log"], n, inputs, height) + above for n in range(inputs)]
                nodes = [at(row["log"], position(0, n, inputs, height)) for n in range(inputs)]
                yield pa.RecordBatch.from_arrays(finish(row, items, nodes, ways), names)

    return listed.mapInArrow(lean(run), schema)


def _handed(row: dict, items: pa.StructArray, nodes: list[bytes], ways: list) -> list[pa.Array]:
    """The paths as they are."""
    steps = [[{"place": place, "run": run} for place, run in way] for way in ways]
    return [
        items.field("key"), pa.array([row["subroot"]] * len(nodes), pa.binary()), pa.array(nodes, pa.binary()), pa.array(steps, _PATH_ARROW)
    ]


def paths(rounds: Sequence[DataFrame], tops: DataFrame, carried: str, finish: Finish, schema: str) -> DataFrame:
    """What ``finish`` makes of every leaf and its path to the root above ``tops``.

    tops: tree, subroot, path (above the tree's root). Rounds go from the last one down; each
    hands its inputs their paths, so a span is joined with one row of its own.
    """
    reached = None
    for number in range(len(rounds) - 1, -1, -1):
        spans = rounds[number]
        own = spans.where(f"round_size <= {SPAN}").join(tops, "tree")
        if reached is not None:
            handed = spans.where(f"round_size > {SPAN}").join(reached, ["tree", "block"])
            own = own.unionByName(handed.select(*own.columns))
        if number:
            key = "'key', named_struct('tree', tree, 'block', i.place)"
            handed_down = f"key struct<tree:string,block:long>, subroot binary, node binary, {_PATH}"
            reached = stash(_ways(own, key, _handed, handed_down).selectExpr("key.*", "subroot", "path"), "paths")
    return _ways(own, carried, finish, schema)


class Manifest:
    """The trees of all sources of documents and the tree over their roots."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        rows = ranked(stash(leaves(docs), "leaves"), ["tree"], ["doc_id", "node", "row"])
        self.rounds = build(rows.withColumnRenamed("group_size", "size").drop("row"))
        sources = ranked(tree_roots(self.rounds).selectExpr("'' as over", "tree", "node"), ["over"], ["tree"])
        self.top_rounds = build(sources.selectExpr("over as tree", "group_size as size", "place", "node", "tree as key"))
        top = tree_roots(self.top_rounds).first()
        self.root: bytes | None = top and bytes(top.node)
        none = spark.createDataFrame([("", b"", [])], f"tree string, subroot binary, {_PATH}")
        handed = f"key string, subroot binary, node binary, {_PATH}"
        self.source_paths = stash(
            paths(self.top_rounds, none, "'key', i.key", _handed, handed).selectExpr("key as tree", "node as subroot", "path"), "paths"
        )

    def log(self) -> DataFrame:
        """The whole postorder log of every source: tree, position (without gaps from 0), level, digest."""
        result = None
        for number, spans in enumerate(self.rounds):
            part = _log_rows(spans, number)
            result = part if result is None else result.unionByName(part)
        return result


def _log_rows(spans: DataFrame, number: int) -> DataFrame:
    schema = "tree string, position long, level int, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                inputs, height = span_height(row["block"], row["round_size"])
                total = tree_height(row["size"])
                for level, count in enumerate(level_counts(inputs, height)):
                    if level == 0 and number:  # the round before has them
                        continue
                    for n in range(count):
                        high, name = 2 * number + level, row["block"] * FAN ** (2 - level) + n
                        rows.append((row["tree"], position(high, name, row["size"], total), high, at(row["log"], position(level, n, inputs, height))))
            names = ("tree", "position", "level", "digest")
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))

    return spans.select("tree", "size", "block", "round_size", "log").mapInArrow(lean(run), schema)


def proofs(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Each row's leaf, subroot, root, digest of its proof, and what its (tampered) leaf and siblings fold to.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and with ``whole``
    proof: the siblings' hex digests, joined.
    """
    manifest = Manifest(docs)
    root = manifest.root

    def finish(row: dict, items: pa.StructArray, nodes: list[bytes], ways: list) -> list[pa.Array]:
        beside = [siblings(way) for way in ways]
        ends = [folded(changed or node, way) for node, changed, way in zip(nodes, items.field("tampered").to_pylist(), ways)]
        texts = [
            [n.hex() for n in nodes], [row["subroot"].hex()] * len(nodes), [root.hex()] * len(nodes),
            [node_of([b]).hex() for b in beside], [e.hex() for e in ends],
        ]
        proof = [pa.array([b.hex() for b in beside], pa.string())] if whole else []
        return [items.field("doc_id"), *[pa.array(t, pa.string()) for t in texts], pa.array([e == root for e in ends], pa.bool_()), *proof]

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return paths(
        manifest.rounds, manifest.source_paths, "'doc_id', i.doc_id, 'tampered', i.tampered", finish, schema + (", proof string" if whole else "")
    )
