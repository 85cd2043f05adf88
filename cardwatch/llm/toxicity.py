"""Toxicity: a learned lexicon, matched with misspellings, judged in its context.

Training (``fit``) reads at most ``TRAIN_ROWS`` labelled documents of each class, those
with the smallest hash of their id. Words and word beginnings that are in far more toxic
documents than clean ones, by their log odds, become the lexicon; a clean document that
only quotes a term counts as a part (``QUOTED``) of one. An entry may be misspelled by so many edits as
catch hardly any clean training document. Scoring runs every word through a Levenshtein
automaton intersected with the lexicon trie, and tokens with digits or symbols among their
letters as a whole, unless a word in them is a hit already. A hit counts with its weight, less for each
edit, and less when its context window shows a quotation: the term stands between
quotation marks, in a quoted line, or beside a word that reports speech. A logistic curve
fitted on the training documents turns the sum into a score.

Defined cases: a null or empty text has no hits and gets the score of hitless documents.
Labels that are null are left out, and so is an id with both labels; without toxic or without clean training documents the
lexicon is empty and every score is the share of toxic labels (0 without labels). Repeated
documents give repeated rows; further columns of either input are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import lean, stash
from cardwatch.llm.lexicon_automaton import LexiconAutomaton
from cardwatch.llm.ngram_join import shingles

TRAIN_ROWS = 4000
THRESHOLD = 0.7
BEGINNINGS = (3, 4, 5, 6)
LEAST_DOCS, LEAST_SHARE = 3, 0.01
LEAST_LOG_ODDS = 3.0
CLEAN_SHARE = 0.001
WINDOW_CHARS = 100
QUOTED = 0.4
EDIT = 0.7

_WORD = re.compile(r"[^\W\d_]+")
# Runs of letters, digits and the symbols that stand for letters; inside, other symbols, too.
_TOKEN = re.compile(r"[\w@$*!]+(?:[.'+|#%&^~-][\w@$*!]+)*")
_REPORTING = frozenset("said says wrote writes called calls quote quoted quoting according reported reports term word".split())
_OPENING, _CLOSING = "«“„‹", "»”“›"


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def disguised_of(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, token, its words) of the tokens of a lower-cased text with digits or symbols among their letters."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip("!*")
        if len(token) >= BEGINNINGS[0] and not token.isalpha() and (words := _WORD.findall(token)):
            if words != [token.strip("_'")]:
                out.append((m.start(), m.start() + len(token), token, words))
    return out


def is_quoted(text: str, start: int, end: int) -> bool:
    """The context window of text[start:end] shows a quotation rather than an address."""
    line = text.rfind("\n", 0, start) + 1
    before = text[max(line, start - WINDOW_CHARS) : start]
    stop = text.find("\n", end)
    after = text[end : min(len(text) if stop < 0 else stop, end + WINDOW_CHARS)]
    if text[line:start].lstrip().startswith(">"):
        return True
    if before.count('"') % 2 and '"' in after:
        return True
    opened = max(before.rfind(c) for c in _OPENING)
    if opened >= 0 and not any(c in before[opened + 1 :] for c in _CLOSING) and any(c in after for c in _CLOSING):
        return True
    near = _WORD.findall(before.lower())[-4:] + _WORD.findall(after.lower())[:3]
    return any(w in _REPORTING for w in near)


def _may_quote(lower: str) -> bool:
    """Whether is_quoted can hold anywhere in the text."""
    return any(c in lower for c in '>"' + _OPENING) or not _REPORTING.isdisjoint(_WORD.findall(lower))


def _automaton(model: dict) -> LexiconAutomaton:
    """Built once per worker process, with the broadcast model it belongs to."""
    if "automaton" not in model:
        model["automaton"] = LexiconAutomaton([entry[:3] for entry in model["entries"]])
    return model["automaton"]


def find_hits(text: str | None, model: dict) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, entry, edits, quoted) of every lexicon hit."""
    match = _automaton(model).match
    lower = (text or "").lower()
    found = {w: hit for w in words_of(text) if (hit := match(w)) is not None}
    places = [(m.start(), m.end(), found[m[0]]) for m in _WORD.finditer(lower) if m[0] in found] if found else []
    for start, end, token, words in disguised_of(lower):
        if found.keys().isdisjoint(words) and (hit := match(token)) is not None:
            places.append((start, end, hit))
    return [(start, end, k, e, is_quoted(lower, start, end)) for start, end, (e, k) in sorted(places)]


def total(hits: list, model: dict) -> float:
    return sum(model["entries"][k][3] * EDIT**edits * (QUOTED if quoted else 1.0) for _, _, k, edits, quoted in hits)


def score_of(hits: list, model: dict) -> float:
    return 1.0 / (1.0 + math.exp(-(model["intercept"] + model["slope"] * math.log1p(total(hits, model)))))


def training_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, y of at most so many labelled texts of either class, by the hash of the id.

    A label given twice counts once, and an id with both labels is left out. Of texts that
    share their least shingle under one of two orders (copies and near copies, as a rule) one
    stays, so that a group of copies can't pass for evidence.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    chosen = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = one if chosen is None else chosen.unionByName(one)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most 2 * rows ids: a proven bound for the broadcast.
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", "y")
    sample = sample.mapInArrow(_least_shingles, "text string, y int, h1 long, h2 long")
    for h in ("h1", "h2"):
        sample = sample.groupBy(h).agg(F.min(F.struct(F.xxhash64("text"), "text", "y", "h2")).alias("s")).select("s.text", "s.y", "s.h2")
    return stash(sample.select("text", "y"), "training")


@lean
def _least_shingles(batches):
    for batch in batches:
        sets = [shingles(t) for t in batch.column(0).to_pylist()]
        least = [(int(s[0]), int((s * 0x2545F4914F6CDD1D).min())) if len(s) else (0, 0) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array([x[k] for x in least], pa.int64()) for k in (0, 1))], names=["text", "y", "h1", "h2"]
        )


def _units_of(word: str) -> set[str]:
    own = {word} if len(word) >= BEGINNINGS[0] else set()
    return own | {word[:k] + "*" for k in BEGINNINGS if len(word) > k}


@lean
def _units(batches):
    for batch in batches:
        units, ys, counts = [], [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lower = (text or "").lower()
            own = set().union(*map(_units_of, words_of(text)))
            addressed = own
            # Where quotations have marks or a reporting word, each occurrence is looked at.
            if not y and _may_quote(lower):
                addressed = set().union(*(_units_of(m[0]) for m in _WORD.finditer(lower) if not is_quoted(lower, m.start(), m.end())))
            units += own
            ys += [y] * len(own)
            counts += [1.0 if u in addressed else QUOTED for u in own]
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(ys, pa.int32()), pa.array(counts, pa.float64())], names=["unit", "y", "n"])


def _lexicon(counts: list, n_toxic: int, n_clean: int) -> list[tuple[str, bool, int, float]]:
    """Entries of enough weight; a beginning only if no longer one or whole word says as much."""
    weight = {}
    for unit, toxic, clean in counts:
        odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if odds >= LEAST_LOG_ODDS:
            weight[unit] = (odds, toxic)
    kept = {}
    for unit, (odds, toxic) in weight.items():
        stem = unit.rstrip("*")
        if unit.endswith("*") and any(
            other != unit and other.startswith(stem) and n >= 0.95 * toxic for other, (_, n) in weight.items()
        ):
            continue
        kept[unit] = odds
    beginnings = {u[:-1] for u in kept if u.endswith("*")}
    out = []
    for unit, odds in sorted(kept.items()):
        stem = unit.rstrip("*")
        if any(stem[:k] in beginnings for k in range(1, len(stem) + (not unit.endswith("*")))):
            continue
        size = len(stem)
        out.append((stem, unit.endswith("*"), 1 if size < 8 else 2, odds))
    return out


def _hits_by_edits(model):
    def run(batches):
        for batch in batches:
            rows = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # Every entry that catches a token counts, since another with fewer edits may be narrowed.
                match, least = _automaton(model.value).match_all, {}
                for token in words_of(text) | {token for _, _, token, _ in disguised_of((text or "").lower())}:
                    for k, e in match(token).items():
                        least.setdefault(k, set()).add(e)
                rows += [(k, e, y) for k, edits in least.items() for e in edits]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], names=["k", "e", "y"])

    return lean(run)


def _sums(model):
    def run(batches):
        for batch in batches:
            x = [math.log1p(total(find_hits(t, model.value), model.value)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

    return lean(run)


def _logistic(x: np.ndarray, y: np.ndarray, shrink: float = 0.05, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton steps, the slope shrunk a little."""
    features, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    penalty = np.array([1e-3, shrink])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (p - y) + penalty * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag(penalty)
        step = np.linalg.solve(hessian, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """The model: entries (text, is_beginning, edits, weight), intercept and slope."""
    sc = documents.sparkSession.sparkContext
    sample = training_sample(documents, labels, label, rows)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / (n_toxic + n_clean) if n else 0.0
        return {"entries": [], "intercept": 30.0 if share == 1 else -30.0, "slope": 0.0}
    units = sample.mapInArrow(_units, "unit string, y int, n double").groupBy("unit")
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    counts = units.agg(F.sum("y").alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0.0)).alias("clean")).where(F.col("toxic") >= least)
    # The least odds of _lexicon, and a little less, so that rounding decides nothing here.
    worth = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1)) >= LEAST_LOG_ODDS - 0.01
    # At most (units of a document / LEAST_SHARE) rows come back.
    model = {"entries": _lexicon([tuple(r) for r in counts.where(worth).collect()], n_toxic, n_clean)}
    caught = sample.mapInArrow(_hits_by_edits(sc.broadcast(dict(model))), "k int, e int, y int").where("y = 0 and e > 0")
    clean = {(r["k"], r["e"]): r["count"] for r in caught.groupBy("k", "e").count().collect()}
    entries = []
    for k, (stem, begins, edits, weight) in enumerate(model["entries"]):
        allowed = 0
        while allowed < edits and clean.get((k, allowed + 1), 0) <= CLEAN_SHARE * n_clean:
            allowed += 1
        entries.append((stem, begins, allowed, weight))
    model = {"entries": entries}
    data = sample.mapInArrow(_sums(sc.broadcast(dict(model))), "x double, y int").toPandas()
    intercept, slope = _logistic(data["x"].to_numpy(float), data["y"].to_numpy(float))
    return model | {"intercept": intercept, "slope": max(0.0, slope)}


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int64()), ("quoted", pa.bool_())]))


def _score(model):
    def run(batches):
        for batch in batches:
            value = model.value
            hits = [find_hits(t, value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([score_of(h, value) for h in hits], pa.float64()),
                    pa.array([[{"start": a, "end": b, "term": value["entries"][k][0], "edits": e, "quoted": q} for a, b, k, e, q in h] for h in hits], _HITS),
                ],
                names=["doc_id", "score", "hits"],
            )

    return lean(run)


def scores(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and hits (code point range, term, edits, quoted) of every document."""
    known = documents.sparkSession.sparkContext.broadcast(dict(model))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(
        _score(known), "doc_id long, score double, hits array<struct<start:long,end:long,term:string,edits:long,quoted:boolean>>"
    )


def _keep(model, column, threshold):
    def run(batches):
        for batch in batches:
            fine = [score_of(find_hits(t.as_py(), model.value), model.value) < threshold for t in batch.column(column)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return lean(run)


def clean_rows(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    known = documents.sparkSession.sparkContext.broadcast(dict(model))
    return documents.mapInArrow(_keep(known, documents.columns.index("text"), threshold), documents.schema)


def fold(buckets: int, held_out: int) -> Column:
    """Rows held out from learning: crc32 of the id as text, modulo buckets, is held_out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(buckets)) == held_out, F.lit(False))
