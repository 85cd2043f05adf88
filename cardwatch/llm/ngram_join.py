"""Similarity join on word shingles with filters under several global token orders.

Two documents link when the Jaccard similarity of their 5-word shingle sets is at least
0.8. Under any global order of the shingles, such sets share one of the first
``n - ceil(0.8 n) + 1``. Candidates share one under the main order (found by a join), and
under ``ORDERS`` further orders (checked on the pair).

Sets are compared only after the filters of all orders are intersected: each set keeps its
prefix under every further order (32 bits a shingle), and a pair without a common entry
under each goes before any text moves.

The main order is by hash, with *common* shingles last: those that more than ``COMMON``
documents carry near the front. A passage that thousands of documents share is therefore
no meeting point, unless documents consist of little else. Each document hands in a few
shingles more than it needs, so that most need no second look once common ones are known;
the others are read again in full.

Links are found in two passes. The first tests the members of a token's group against one of
similar size. Groups of copies collapse there, without any pairs between
copies. The second pass tests pairs of a group that are still in different components,
which is all a component needs: a pair within one component can't change it. The join
that finds them drops pairs whose sizes, places in the order, or parity bits (a bound on
the shingles in which they differ) rule a link out, so a large family of texts that are
alike, but not alike enough, makes few rows.

Equal sets are one class from the start. Shingles are 64-bit hashes, set identities 128
bits. Texts of candidates travel to the comparison, in slices per hub, and are compared
as they stream by.

Defined cases: no words: no shingles, own component. Null ids: such documents take part in
no link unless an equal set has an id; else their component is null. Repeated rows give
repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.base import lean, plain_words, stash
from cardwatch.llm.components import components

WORDS = 5
COMMON = 50
ORDERS = 2
SLICE = 256
SKETCH_LONGS = 8
BLOOM_BITS = 1 << 26

_SKETCH = [f"b{k}" for k in range(SKETCH_LONGS)]
_FURTHER = [f"order{k}" for k in range(ORDERS)]
_SETS = ", ".join([
    "doc_id long", "n long", "identity binary", "front array<long>", *(f"{o} array<int>" for o in _FURTHER), *(f"{b} long" for b in _SKETCH),
])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIN = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    found = plain_words(text)
    if not found:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, found), np.uint64, len(found))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _MIX + h[k : k + n]
        out ^= out >> np.uint64(29)
    out *= _FIN
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def prefix_size(n: int) -> int:
    """So many shingles at the front of any global order hold one that similar sets share."""
    return n - (4 * n + 4) // 5 + 1


def _front_size(n: int) -> int:
    p = prefix_size(n)
    return min(n, p + p // 4 + 8)


def parities(s: np.ndarray) -> np.ndarray:
    """Each shingle turns one bit over. Bits in which two sets differ are at most the shingles in which they do."""
    bits = np.bincount(s & (64 * SKETCH_LONGS - 1), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def later_prefixes(s: np.ndarray, orders: int = ORDERS) -> list[np.ndarray]:
    """The set's prefixes under the further orders, each shingle as 32 bits of its place in the order."""
    p, out = prefix_size(len(s)), []
    for k in range(orders):
        v = s.view(np.uint64) * np.uint64((int(_MIX) + 2 * k * 0x2545F4914F6CDD1D) % 2**64)
        v ^= v >> np.uint64(31)
        out.append((np.partition(v, p - 1)[:p] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if len(s) else np.empty(0, np.int32))
    return out


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, kind)))


@lean
def _sets(batches):
    for batch in batches:
        size, identity, front, sketch = [], [], [], []
        further: list[list[np.ndarray]] = [[] for _ in _FURTHER]
        for text in batch.column(1):
            s = shingles(text.as_py())
            size.append(len(s))
            identity.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            front.append(s[: _front_size(len(s))] if len(s) else s)
            sketch.append(parities(s))
            for column, prefix in zip(further, later_prefixes(s), strict=True):
                column.append(prefix)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(size, pa.int64()), pa.array(identity, pa.binary()),
                _lists(front, np.int64), *(_lists(f, np.int32) for f in further),
                *(pa.array(np.array(b, np.int64)) for b in np.reshape(sketch, (-1, SKETCH_LONGS)).T),
            ],
            names=["doc_id", "n", "identity", "front", *_FURTHER, *_SKETCH],
        )


def _bloom(values: DataFrame) -> np.ndarray:
    """A filter of at most BLOOM_BITS bits that no value of the table's one (long) column fails."""
    bits = min(BLOOM_BITS, 1 << max(12, int(16 * values.count()).bit_length()))
    h = F.xxhash64(values.columns[0])
    both = values.select(F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits)))).alias("p"))
    place = both.selectExpr("p div 32 as w", "shiftleft(1L, cast(p % 32 as int)) as m")
    words = place.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(bits // 32, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return out


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for p in (hashes % (len(bits) * 32), (hashes >> 32) % (len(bits) * 32)):
        out &= (bits[p // 32] >> (p % 32)) & 1 == 1
    return out


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents with these ids and maybe a few others: a bounded filter before any shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(ids))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_passes(bits.value, batch.column(2).to_numpy()))).select([0, 1])

    return docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "id long, text string")


def _handed(sets: DataFrame, ids: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """token, id, n, pos of what documents hand in: those of the ids, maybe a few others, and only of the tokens, likewise.

    Copies that slip through are harmless: they only link to their own class.
    """
    sc = sets.sparkSession.sparkContext
    bits = sc.broadcast(_bloom(ids))
    only = sc.broadcast(_bloom(tokens)) if tokens is not None else None
    rows = sets.where("n > 0 and doc_id is not null").select("doc_id", "n", "front", F.xxhash64("doc_id").alias("h"))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_passes(bits.value, batch.column(3).to_numpy())))
            size = np.array([len(x) for x in batch.column(2)], np.int64)
            if not len(size):
                continue
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).flatten(), *(pa.array(np.repeat(batch.column(k).to_numpy(), size)) for k in (0, 1)), pa.array(pos)],
                names=["token", "id", "n", "pos"],
            )

    def run_only(batches):
        for batch in batches:
            yield batch.filter(pa.array(_passes(only.value, batch.column(4).to_numpy()))).select([0, 1, 2, 3])

    schema = "token long, id long, n long, pos long"
    rows = rows.mapInArrow(run, schema)
    return rows if tokens is None else rows.withColumn("h", F.xxhash64("token")).mapInArrow(run_only, schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = _common(a, b)
    return 100 * both >= 80 * (len(a) + len(b) - both)


@lean
def _compare(batches):
    """Rows come by hub, the hub's own row first."""
    hub, own = None, None
    for batch in batches:
        a, b = [], []
        for key, is_hub, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            s = shingles(text)
            if is_hub:
                hub, own = key, s
            elif key == hub and similar(own, s):
                a.append(doc)
                b.append(hub)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _meeting_in_all(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (hub, id) that share a prefix shingle under every further order, each once.

    Several texts under one id all count: the pair stays if any two of them meet.
    """
    ids = pairs.select("hub").unionByName(pairs.select(F.col("id").alias("hub"))).distinct()
    bits = sets.sparkSession.sparkContext.broadcast(_bloom(ids))
    names = ["doc_id", *_FURTHER]

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_passes(bits.value, batch.column(len(names)).to_numpy()))).select(names)

    known = sets.where("n > 0 and doc_id is not null").select(*names, F.xxhash64("doc_id").alias("h"))
    known = stash(known.mapInArrow(run, "doc_id long, " + ", ".join(f"{o} array<int>" for o in _FURTHER)), "further")
    for role in ("hub", "id"):
        pairs = pairs.join(known.select(F.col("doc_id").alias(role), *[F.col(o).alias(f"{role}_{o}") for o in _FURTHER]), role)
    meet = " and ".join(f"arrays_overlap(hub_{o}, id_{o})" for o in _FURTHER)
    return pairs.where(meet).select("hub", "id").distinct()


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (hub, id) whose texts are similar, as a, b."""
    pairs = stash(_meeting_in_all(sets, stash(pairs, "met")), "meeting")
    pairs = pairs.join(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("of_hub")), "hub")
    pairs = stash(pairs.selectExpr("hub", f"cast(pmod(xxhash64(id), of_hub div {SLICE} + 1) as long) as slice", "id"), "pairs")
    roles = pairs.select("hub", "slice", F.lit(False).alias("is_hub"), "id").unionByName(
        pairs.select("hub", "slice", F.lit(True).alias("is_hub"), F.col("hub").alias("id")).distinct()
    )
    texts = _texts_of(docs, roles.select("id").distinct())
    rows = roles.join(texts, "id").repartition("hub", "slice").sortWithinPartitions("hub", "slice", F.col("is_hub").desc())
    return stash(rows.select("hub", "is_hub", "id", "text").mapInArrow(_compare, "a long, b long"), "links")


def _bounded(pairs: DataFrame) -> DataFrame:
    """Pairs whose overlap can still reach the threshold, from the prefix tokens they share.

    Of the two prefixes, take the one whose end comes first in the order. Up to there all
    shared tokens are known, so at most the rest of that set can be shared besides. And
    behind the last known one at most the shorter remainder can be.
    """
    grouped = pairs.groupBy("hub", "id").agg(
        F.count(F.lit(1)).alias("c"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.first("n1").alias("n1"), F.first("n2").alias("n2")
    )
    behind = "least(n1 - 1 - p1, n2 - 1 - p2, greatest((4 * n1 + 4) div 5 - 1, (4 * n2 + 4) div 5 - 1))"
    return grouped.where(f"9 * (c + {behind}) >= 4 * (n1 + n2)").select("hub", "id")


_SIZES_FIT = "5 * n1 >= 4 * n2 and 5 * n2 >= 4 * n1"


@lean
def _all_tokens(batches):
    for batch in batches:
        sets = [shingles(text.as_py()) for text in batch.column(1)]
        if not sets:
            continue
        size = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.repeat(size, size).astype(np.int64)), pa.array(np.concatenate(sets))],
            names=["id", "n", "token"],
        )


def _main_order(docs: DataFrame, sets: DataFrame, ids: DataFrame, common: int) -> DataFrame:
    """token, id, n, pos, own: prefix shingles under the main order that two or more documents share.

    own: how many of the shingles that the document handed in are its own alone.
    """
    p = F.expr("n - (4 * n + 4) div 5 + 1")
    handed = _handed(sets, ids)
    # Counted by groups, which fold before the shuffle; the join back can be split where a token is hot.
    times = handed.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = stash(handed.join(times, "token"), "shared")
    # How far common shingles move the others forward, and who lacks shingles then.
    each = shared.groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.when(F.col("times") > common, F.col("pos")))).alias("hot_pos"), F.count(F.lit(1)).alias("n_shared")
    )
    each = each.withColumn("p", p).withColumn("handed", F.expr("least(n, p + p div 4 + 8)"))
    each = stash(each.selectExpr("id", "hot_pos", "p", "handed", "handed - size(hot_pos) as rest", "handed - n_shared as own", "n"), "each")
    short = stash(each.where("rest < p and handed < n").select("id"), "short")
    before = F.expr("size(filter(hot_pos, x -> x < pos))")
    kept = shared.join(each.drop("n"), "id")
    kept = kept.withColumn(
        "pos", F.when(F.col("times") > common, F.col("rest") + before).otherwise(F.col("pos") - before).cast("long")
    ).where("pos < p and (rest >= p or handed = n)").select("token", "id", "n", "pos", "own")
    if short.isEmpty():
        return kept
    # Documents of mostly common shingles: order all of theirs, and look their new ones up.
    # Only those that pass a filter of the common ones need the join that tells.
    hot_tokens = stash(shared.where(F.col("times") > common).select("token").distinct(), "hot")
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(hot_tokens))

    def flag(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_passes(bits.value, batch.column(3).to_numpy()))], names=["id", "n", "token", "maybe"])

    texts = _texts_of(docs, short).join(short, "id", "left_semi")
    tokens = texts.mapInArrow(_all_tokens, "id long, n long, token long").withColumn("h", F.xxhash64("token"))
    tokens = stash(tokens.mapInArrow(flag, "id long, n long, token long, maybe boolean").distinct(), "tokens")
    told = tokens.where("maybe").join(hot_tokens.withColumn("hot", F.lit(1)), "token", "left").select("id", "n", "token", "hot")
    told = told.unionByName(tokens.where("not maybe").select("id", "n", "token", F.lit(None).cast("int").alias("hot")))
    ordered = told.withColumn(
        "pos", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("hot", F.lit(0)), "token")).cast("long") - 1
    ).withColumn("p", p).where("pos < p").join(each.select("id", "own"), "id").select("token", "id", "n", "pos", "own")
    ordered = stash(ordered, "ordered")
    new = ordered.select("token").distinct().join(shared.select("token").distinct(), "token", "left_anti")
    new = stash(new, "new")
    lone = _handed(sets, ids, new).join(new, "token", "left_semi").join(short, "id", "left_anti")
    lone = lone.join(each.select("id", "hot_pos", "own"), "id", "left").withColumn("p", p)
    lone = lone.withColumn("pos", F.col("pos") - F.coalesce(before, F.lit(0))).where("pos < p")
    # A document without an entry shares nothing so far: all it handed in is its own.
    lone = lone.select("token", "id", "n", "pos", F.coalesce("own", F.col("n")).alias("own"))
    return kept.unionByName(ordered).unionByName(lone)


def similarity_components(documents: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (least id with an equal set) of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stash(docs.mapInArrow(_sets, _SETS), "sets")
    classes = stash(sets.where("n > 0").groupBy("identity").agg(F.min("doc_id").alias("class_id")), "classes")
    rows = stash(_main_order(docs, sets, classes.select("class_id").where("class_id is not null"), common), "prefixes")

    # First pass: members of a token and size band against the one with the least of its
    # own, which in a family of copies is the text they come from.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25)))
    rows = rows.withColumn("band", band)
    least = rows.groupBy("token", "band").agg(F.min(F.struct("own", "id", F.col("pos").alias("p1"), F.col("n").alias("n1"))).alias("least"))
    stars = rows.join(least, ["token", "band"]).selectExpr("least.id as hub", "id", "least.p1 as p1", "pos as p2", "least.n1 as n1", "n as n2")
    tested = stash(_bounded(stars.where(f"hub <> id and {_SIZES_FIT}")), "stars")
    links = _links(docs, sets, tested)
    group = components(links)

    # Second pass: what still lies in different components.
    placed = rows.join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    sketches = sets.selectExpr("doc_id as id", "n as of_n", *_SKETCH).where("id is not null and of_n > 0").dropDuplicates(["id"]).drop("of_n")
    placed = placed.join(open_tokens, "token").select("token", "id", "n", "pos", "component").join(sketches, "id")
    left = placed.selectExpr("token", "id as hub", "n as n1", "pos as p1", "component as k1", *(f"{b} as l_{b}" for b in _SKETCH))
    right = placed.selectExpr("token", "id", "n as n2", "pos as p2", "component as k2", *(f"{b} as r_{b}" for b in _SKETCH))
    # Similar sets differ in at most a ninth of their shingles together.
    apart = " + ".join(f"bit_count(l_{b} ^ r_{b})" for b in _SKETCH) + " <= (n1 + n2) div 9"
    reach = "9 * (1 + least(n1 - 1 - p1, n2 - 1 - p2) + least(p1, p2)) >= 4 * (n1 + n2)"
    pairs = left.join(right, "token").where(f"hub < id and k1 <> k2 and {_SIZES_FIT} and {reach} and {apart}")
    known = tested.selectExpr("least(hub, id) as hub", "greatest(hub, id) as id")
    rest = _links(docs, sets, _bounded(pairs).join(known, ["hub", "id"], "left_anti"))
    group = components(group.selectExpr("id as a", "component as b").unionByName(rest))

    classes = classes.join(group.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "identity", "class_id", F.coalesce("component", "class_id").alias("component")
    )
    return sets.join(classes, "identity", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def one_of_each(documents: DataFrame, common: int = COMMON) -> DataFrame:
    """The documents without those that are linked, directly or not, to one of a smaller id.

    Of repeated rows (equal id and text) one stays. Rows without an id can't be told
    apart by one and stay.
    """
    found = stash(similarity_components(documents, common).select("doc_id", "component_id"), "components").where("doc_id is not null")
    gone = stash(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = documents.join(gone, documents["doc_id"].cast("long") == F.col("_gone"), "left_anti")
    twice = stash(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")), "twice")
    if twice.isEmpty():
        return kept
    is_twice = kept["doc_id"].cast("long") == F.col("_twice")
    return kept.join(twice, is_twice, "left_anti").unionByName(kept.join(twice, is_twice, "left_semi").dropDuplicates(["doc_id", "text"]))
