"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins, and the model is a sum of lookup tables: one per feature
and one per chosen pair of features. Training goes round the features again and again; in
each turn a shallow tree on the bins of one feature takes a small step against the
gradient of the logistic loss, so that no feature takes what another explains as well.
The pairs that explain most of what is left then get tables of their own in the same way.
A score is the logistic of the summed table entries, looked up for whole columns at once.

Training reads at most ``TRAIN_ROWS`` labelled documents of each class (by the hash of
their ids, without near copies), weighted back to the classes' true shares.

Defined cases: a null or empty text has zero features and gets their score. Null labels
are left out, and so is an id with both labels; with one class only, every score is the share of label 1 (0.5 without
labels). Repeated documents give repeated rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import lean
from cardwatch.llm.text_stats import STATS, statistics
from cardwatch.llm.toxicity import training_sample

TRAIN_ROWS = 4000
THRESHOLD = 0.7
BINS = 32
ROUNDS = 120
PAIRS = 5
PAIR_ROUNDS = 40
RATE = 0.15
LEAVES = 3
SHRINK = 2.0

FEATURES = (
    "log_words", "word_length", "symbols", "repeated", "dup_lines", "upper", "digits", "marks", "ended", "distinct",
    "lone", "long_words", "adjacent", "line_words",
)


def features(rows: list[tuple[int, ...]]) -> np.ndarray:
    """One row per statistics tuple, in the order of FEATURES."""
    s = dict(zip(STATS, np.array(rows, float).reshape(-1, len(STATS)).T, strict=True))
    words, lines, letters = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1), np.maximum(s["n_letters"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_repeat_words"] / words, s["n_dup_lines"] / lines,
        s["n_upper"] / letters, s["n_digits"] / letters, s["n_marks"] / words, s["n_ended_lines"] / lines,
        s["n_distinct_words"] / words, s["n_lone_marks"] / words, s["n_long_words"] / words, s["n_adjacent"] / words, words / lines,
    ], 1)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin borders at quantiles of the distinct values, so that a mass of equal ones takes one bin."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(values, np.linspace(0, 1, bins)))
    return (values[1:] + values[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values by bin of a tree with a few leaves, split greedily where the loss falls most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's bins into four fields: how much the loss falls, and the fields' values."""
    corner_g, corner_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows_g, rows_h, cols_g, cols_h = corner_g[:, -1:], corner_h[:, -1:], corner_g[-1:], corner_h[-1:]
    all_g, all_h = corner_g[-1, -1], corner_h[-1, -1]
    fields = [
        (corner_g, corner_h), (rows_g - corner_g, rows_h - corner_h), (cols_g - corner_g, cols_h - corner_h),
        (all_g - rows_g - cols_g + corner_g, all_h - rows_h - cols_h + corner_h),
    ]
    gain = sum(_gain(a, np.maximum(b, 0)) for a, b in fields)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    places = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for place in places:
        out[place] = -g[place].sum() / (h[place].sum() + SHRINK)
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: int = PAIRS) -> dict:
    """The tables of a model for features x and labels y."""
    cuts = [_cuts(column, BINS) for column in x.T]
    place = [np.searchsorted(c, column, "right") for c, column in zip(cuts, x.T, strict=True)]
    size = [len(c) + 1 for c in cuts]
    share = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4))
    intercept = float(np.log(share / (1 - share)))
    tables, score = [np.zeros(n) for n in size], np.full(len(y), intercept)

    def slopes():
        p = 1 / (1 + np.exp(-score))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k, n in enumerate(size):
            g, h = slopes()
            step = RATE * _tree(np.bincount(place[k], g, n), np.bincount(place[k], h, n))
            tables[k] += step
            score += step[place[k]]
    g, h = slopes()
    ranked = []
    for a in range(len(size)):
        for b in range(a + 1, len(size)):
            if size[a] > 1 and size[b] > 1:
                cell = place[a] * size[b] + place[b]
                shape = (size[a], size[b])
                fall, _ = _square(np.bincount(cell, g, size[a] * size[b]).reshape(shape), np.bincount(cell, h, size[a] * size[b]).reshape(shape))
                ranked.append((-fall, a, b))
    chosen = [(a, b) for _, a, b in sorted(ranked)[:pairs]]
    squares = [np.zeros((size[a], size[b])) for a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(chosen):
            g, h = slopes()
            cell, shape = place[a] * size[b] + place[b], (size[a], size[b])
            _, step = _square(np.bincount(cell, g, size[a] * size[b]).reshape(shape), np.bincount(cell, h, size[a] * size[b]).reshape(shape))
            squares[k] += RATE * step
            score += RATE * step[place[a], place[b]]
    return {"cuts": cuts, "tables": tables, "pairs": chosen, "squares": squares, "intercept": intercept}


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    """Scores of whole columns: table entries looked up by bin and added."""
    place = [np.searchsorted(c, column, "right") for c, column in zip(model["cuts"], x.T, strict=True)]
    total = np.full(len(x), model["intercept"])
    for table, at in zip(model["tables"], place, strict=True):
        total += table[at]
    for (a, b), square in zip(model["pairs"], model["squares"], strict=True):
        total += square[place[a], place[b]]
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


@lean
def _sample_features(batches):
    for batch in batches:
        x = features([statistics(t) for t in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """A model from labelled documents."""
    known = {r["y"]: r["n"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    data = training_sample(documents, labels, label, rows).mapInArrow(_sample_features, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in data], float)
    if not 0 < y.sum() < len(y):
        share = y.mean() if len(y) else 0.5
        flat = float(np.clip(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9)), -30, 30))
        return {"cuts": [np.empty(0)] * len(FEATURES), "tables": [np.zeros(1)] * len(FEATURES), "pairs": [], "squares": [], "intercept": flat}
    of_class = {c: known[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, of_class[1], of_class[0])
    order = np.lexsort(np.array([r["x"] for r in data]).T)
    x = np.array([r["x"] for r in data])[order]
    return train(x, y[order], (weight / weight.mean())[order])


def _score(model):
    def run(batches):
        for batch in batches:
            x = features([statistics(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(x, model.value), pa.float64())], names=["doc_id", "score"])

    return lean(run)


def scores(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 is likelier) of every document."""
    known = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(known), "doc_id long, score double")
