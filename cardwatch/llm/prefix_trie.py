"""Trie of conversation prefixes, with totals over every subtree.

A node is a distinct sequence of first turns; its members are the conversations that start
with it. Its identity is a sum of hashes of (place, turn), so prefixes are found by running
sums, without going through a conversation turn by turn.

*Depth-band rollup.* Depths are cut into bands of fixed height. A node hands its values only
to its ancestors in its own band, which lie in one group of at most ``BAND`` rows of its
smallest member. That completes the totals within bands; the roots of the bands then form a
tree of 1/BAND of the depth, which is rolled up alike, and the completed total of a band root
goes to its ancestors in the band above it. So a row explodes into at most ``BAND`` rows a
round, and the rounds grow with the logarithm of the depth.

The smallest member of a node is the smallest member of one of its children, or ends there:
what a conversation is smallest member of is a stretch of its path. The stretch folds to
sums before it explodes.

Defined cases. A null role or text is empty. Turns of one number go by role, then by a
hash of role and text. Turns without conv_id form one conversation without an id: it keeps
its own turns, counts as a member, is larger than all others, and enters no list of ids; a
node that it alone reaches has a null conv_id. Repeated turns are turns of their own. An empty
table gives no rows. Columns beyond the four are not read. Hashes have 128 bits; apart from
their collisions the result is exact.

A list of ids that end at one node can only be digested from its start to its end. The ids
are joined in pieces of 1,024 by many tasks; a list of several pieces then goes through one
task as a stream, so that task's memory is bounded, but not its time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import lean, stash
from cardwatch.llm.ranks import ranked, running_sums

BAND = 8
PIECE = 1024
# A conversation: whether it lacks an id, and its id (0 without).
_CONV = ["no_id", "conv"]
_KEY = ["k1", "k2"]
_PARENT = ["p1", "p2"]
_SUMS = ["s0", "s1", "s2", "s3"]


# --- turns ------------------------------------------------------------------------

def numbered_turns(conversations: DataFrame) -> DataFrame:
    """no_id, conv, place (from 0), group_size (turns of the conversation), t1, t2 (hash of role and text), chars of the text."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        conversations["conv_id"].isNull().cast("int").alias("no_id"),
        F.coalesce(conversations["conv_id"].cast("long"), F.lit(0)).alias("conv"),
        conversations["turn"].alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.char_length(text).cast("long").alias("chars"),
    )
    return ranked(stash(turns, "turns"), _CONV, ["turn", "role", "t1", "t2"]).drop("turn", "role")


def rebuilt(conversations: DataFrame, family: int = 100, most_shared: int = 6) -> DataFrame:
    """no_id, conv, depth (from 1), t1, t2, chars, size: every conversation with its shared beginning, then its own turns.

    The first h turns come from conversation conv - conv % family, where h is the CRC-32 of
    the id modulo ``most_shared``; what the conversation itself has after its first h turns follows.
    A conversation without turns is one row of depth 0.
    """
    turns = stash(numbered_turns(conversations), "turns")
    convs = turns.groupBy(*_CONV).agg(F.max("group_size").alias("own"))
    with_id = F.col("no_id") == 0
    h = F.when(with_id, F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most_shared))).otherwise(F.lit(0)).cast("long")
    based = convs.withColumns({"h": h, "base": F.expr(f"conv - conv % {family}")})
    sizes = convs.where(with_id).select(F.col("conv").alias("base"), F.col("own").alias("of_base"))
    based = based.join(sizes, "base", "left").withColumn("shared", F.least("h", F.coalesce("of_base", F.lit(0))))
    based = stash(based.select(*_CONV, "base", "h", "shared", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "convs")
    beginnings = turns.where(with_id & (F.col("place") < most_shared)).select(F.col("conv").alias("base"), "place", "t1", "t2", "chars")
    first = based.where(with_id & (F.col("shared") > 0)).join(beginnings, "base").where(F.col("place") < F.col("shared"))
    first = first.select(*_CONV, (F.col("place") + 1).alias("depth"), "t1", "t2", "chars", "size")
    rest = turns.drop("group_size").join(based, _CONV).where(F.col("place") >= F.col("h"))
    rest = rest.select(*_CONV, F.expr("shared + place - h + 1").alias("depth"), "t1", "t2", "chars", "size")
    none = based.select(*_CONV, *[F.lit(0).cast("long").alias(c) for c in ("depth", "t1", "t2", "chars")], "size")
    return none.unionByName(first).unionByName(rest)


# --- nodes ------------------------------------------------------------------------

def _pieces_of_hash() -> list[Column]:
    """A turn at its depth as four numbers of 32 bits, whose sums can't overflow; nothing for the root."""
    halves = [F.xxhash64("depth", "t1", "t2"), F.xxhash64(F.lit(1), "t2", "depth", "t1")]
    parts = [part for half in halves for part in (F.shiftrightunsigned(half, 32), half.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [F.when(F.col("depth") > 0, part).otherwise(F.lit(0)).alias(name) for name, part in zip(_SUMS, parts)]


def _identity(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *sums), F.xxhash64(F.lit(1), *reversed(sums), depth)]


def steps(turns: DataFrame) -> DataFrame:
    """One row per conversation and depth: the node (k1, k2) and its parent (p1, p2), chars, and whether the conversation ends there."""
    named = turns.select(*_CONV, "depth", "chars", "size", *_pieces_of_hash())
    own = named.withColumns({f"own_{c}": F.col(c) for c in _SUMS})
    summed = running_sums(own, _CONV, "depth", _SUMS)
    k1, k2 = _identity(F.col("depth"), [F.col(c) for c in _SUMS])
    p1, p2 = _identity(F.col("depth") - 1, [F.col(c) - F.col(f"own_{c}") for c in _SUMS])
    return summed.select(
        *_CONV, "depth", "chars", (F.col("depth") == F.col("size")).alias("ends"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2")
    )


def nodes(walked: DataFrame) -> DataFrame:
    """One row a node: its smallest member (no_id, conv), depth, parent, n_convs, n_ends, chars of its last text."""
    folded = walked.groupBy(*_KEY).agg(
        F.min(F.struct(*_CONV)).alias("least"), F.min("depth").alias("depth"), *[F.min(p).alias(p) for p in _PARENT],
        F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min("chars").alias("chars"),
    )
    return folded.select(*_KEY, "least.*", "depth", *_PARENT, "n_convs", "n_ends", "chars")


# --- rollup -------------------------------------------------------------------------

def _handed_up(paths: DataFrame, values: DataFrame, band: int) -> DataFrame:
    """Each value to its ancestors in its band and itself; values of one stretch are added up first."""
    stretches = values.withColumn("band", F.expr(f"depth div {band}")).groupBy(*_CONV, "band").agg(
        F.collect_list(F.struct(F.expr(f"depth % {band}").alias("at"), "leaves", "saved")).alias("values")
    )

    def below(field: str) -> str:
        return f"aggregate(filter(values, v -> v.at >= i), 0L, (s, v) -> s + v.{field})"

    given = F.expr(
        f"inline(filter(transform(path, (p, i) -> named_struct('k1', p.k1, 'k2', p.k2, 'leaves', {below('leaves')}, 'saved', {below('saved')})),"
        " g -> g.leaves > 0 or g.saved > 0))"
    )
    return paths.join(stretches, [*_CONV, "band"]).select(given)


def _totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rollup(walked: DataFrame, values: DataFrame, deepest: int, band: int = BAND) -> DataFrame:
    """Totals of leaves and saved over every subtree that has any.

    walked: no_id, conv, depth, k1, k2 of every conversation's path. values: k1, k2, no_id, conv
    (the smallest member), depth, leaves, saved.
    """
    paths = walked.groupBy(*_CONV, F.expr(f"depth div {band}").alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("depth", *_KEY))).alias("path")
    )
    within = _totals(_handed_up(paths, values, band))
    if deepest < band:
        return within
    within, paths = stash(within, "within-bands"), stash(paths, "band-paths")
    band_roots = F.col("depth") % band == 0
    raised = F.expr(f"depth div {band}")
    roots = values.where(band_roots).select(*_KEY, *_CONV, raised.alias("depth"))
    above = walked.where(band_roots).select(*_CONV, raised.alias("depth"), *_KEY)
    # A root without anything in its band still stands for what is below the band.
    raised_values = roots.join(within, _KEY, "left").fillna(0, ["leaves", "saved"])
    completed = stash(rollup(above, raised_values, deepest // band, band), "band-totals")
    crossing = roots.where("depth > 0").join(completed, _KEY).withColumn("band", F.col("depth") - 1)
    handed = crossing.drop(*_KEY).join(paths, [*_CONV, "band"]).select(F.explode("path").alias("p"), "leaves", "saved")
    return _totals(within.unionByName(handed.select("p.k1", "p.k2", "leaves", "saved")))


# --- ids that end at a node --------------------------------------------------------

def _streamed_digest(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each node's pieces in order; a piece at a time is in memory."""
    placed = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece").select("k1", "k2", "piece", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(node, digest):
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([digest.hexdigest()])], ["k1", "k2", "ends_sha256"])

        node = digest = None
        for batch in batches:
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                if (k1, k2) != node:
                    if node is not None:
                        yield row(node, digest)
                    node, digest = (k1, k2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if node is not None:
            yield row(node, digest)

    return placed.mapInArrow(lean(run), "k1 long, k2 long, ends_sha256 string")


def end_digests(walked: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of every node where some conversation with an id ends."""
    ends = stash(walked.where(F.col("ends") & (F.col("no_id") == 0)).select(*_KEY, "conv"), "ends")
    placed = ranked(ends, _KEY, ["conv"]).withColumn("piece", F.expr(f"place div {PIECE}"))
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = placed.groupBy(*_KEY, "piece").agg(F.max("group_size").alias("n"), F.array_join(ids, ",").alias("text"))
    pieces = stash(pieces, "end-lists")
    single = pieces.where(F.col("n") <= PIECE).select(*_KEY, F.sha2("text", 256).alias("ends_sha256"))
    return single.unionByName(_streamed_digest(pieces.where(F.col("n") > PIECE)))


# --- the whole ---------------------------------------------------------------------

def trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with members, children and subtree totals."""
    walked = stash(steps(rebuilt(conversations)), "walked")
    found = stash(nodes(walked), "nodes")
    deepest = found.agg(F.max("depth")).first()[0] or 0
    values = found.select(
        *_KEY, *_CONV, "depth",
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    totals = rollup(walked.select(*_CONV, "depth", *_KEY), values, deepest, band)
    nothing = F.lit(0).cast("long")
    children = found.where("depth > 0").select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), nothing.alias("leaves"), nothing.alias("saved"), F.lit(1).cast("long").alias("children")
    )
    summed = totals.withColumn("children", nothing).unionByName(children).groupBy(*_KEY).agg(
        *[F.sum(c).alias(n) for c, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"), ("children", "n_children"))]
    )
    shown = F.when(F.col("no_id") == 0, F.col("conv"))
    parents = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), shown.alias("parent_conv_id"))
    joined = found.join(summed, _KEY, "left").join(end_digests(walked), _KEY, "left").join(parents, _PARENT, "left")

    def number(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)).cast("long").alias(column)

    return joined.select(
        shown.alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"),
        number("n_children"), number("n_leaves"), number("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
