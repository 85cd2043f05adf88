"""Quality rules and the additive model."""

import re
from collections import Counter

import numpy as np
import pytest

from cardwatch.llm import base, quality_gam, quality_rules, text_stats, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w, seen, dup, hit = WORD.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    for k in range(len(w) - 7):
        if windows[tuple(w[k : k + 8])] > 1:
            hit.update(range(k, k + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


TEXTS = [
    None, "", " \n\t", "a", "a b c d e f g h", "x " * 9, "a b c d e f g h " * 3, "a b   c\u000bd\u001cz", "# * $\n# * $\n\n\n#",
    "L1 same\nL1 same\nL1 same \n", "é" * 50 + " \U0001f600 | <p>", "a b " * 4 + "c " + "a b " * 4, "w%d " * 20,
]


def test_base_statistics_equal_brute_force(lm, sf):
    texts = TEXTS + [r.text for r in base.table(lm, sf, "documents").select("text").collect()]
    for text in texts:
        s = dict(zip(text_stats.STATS, text_stats.statistics(text), strict=True))
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == brute(text)


def test_posterior_separates_and_keeps_clean_texts(lm):
    sf = "/root/testdata/sf0.01"
    judged = quality_rules.verdicts(base.table(lm, sf, "documents")).join(base.table(lm, sf, "labels"), "doc_id").collect()
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r for r in judged if r.quality == 0]
    assert all(r.kept for r in good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    assert all(0 <= r.posterior <= 1 for r in judged)


def test_estimation_finds_accuracies():
    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.8
    votes = np.stack([np.where(r.random(20_000) < 0.1, -1, np.where(good, r.random(20_000) > 0.01, r.random(20_000) > 0.9).astype(int)) for _ in range(4)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, chance, posterior = quality_rules.estimate(patterns, counts.astype(float), np.full(4, 0.01))
    table = {tuple(p): x for p, x in zip(patterns.tolist(), posterior, strict=True)}
    right = np.mean([(table[tuple(v)] >= 0.5) == g for v, g in zip(votes.tolist(), good, strict=True)])
    assert right > 0.98
    assert np.abs(chance[0] - 0.01).max() < 0.01


def test_rules_on_edge_cases(frame):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "a b", "y"), (3, "a", "z")]
    found = quality_rules.verdicts(frame(rows, "doc_id long, text string, votes string")).collect()
    assert len(found) == len(rows)
    assert all(r.base_failed and not r.kept for r in found)
    assert quality_rules.verdicts(frame([])).collect() == []


def test_additive_model_on_held_out_documents(lm):
    sf = "/root/testdata/sf0.01"
    documents, labels, held = base.table(lm, sf, "documents"), base.table(lm, sf, "labels"), toxicity.fold(4, 2)
    model = quality_gam.fit(documents, labels.where(~held))
    found = quality_gam.scores(documents, model).withColumn("held", held).join(labels, "doc_id").where("held").collect()
    right = [(r.score >= quality_gam.THRESHOLD) == (r.quality == 1) for r in found]
    assert np.mean(right) >= 0.95


def test_model_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    flat = quality_gam.train(x, y, np.ones(3000), pairs=0)
    paired = quality_gam.train(x, y, np.ones(3000), pairs=1)
    test = r.random((1000, 3))
    truth = (test[:, 0] > 0.5) ^ (test[:, 1] > 0.5)
    assert np.mean((quality_gam.predict(test, paired) > 0.5) == truth) > 0.9
    assert np.mean((quality_gam.predict(test, flat) > 0.5) == truth) < 0.7
    assert paired["pairs"] == [(0, 1)]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, None)]])
def test_model_without_both_classes(frame, labels):
    docs = frame([(1, "a b", 7), (2, None, 8), (None, "", 9)], "doc_id long, text string, score long")
    model = quality_gam.fit(docs, frame(labels, "doc_id long, quality int"))
    found = quality_gam.scores(docs, model).collect()
    assert len(found) == 3 and all(0 <= r.score <= 1 for r in found)
