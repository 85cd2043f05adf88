"""Similarity components against all pairs."""

import itertools
import random

import numpy as np
import pytest

from cardwatch.llm import components, ngram_join


def sets_of(text):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {d: sets_of(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(seed=5):
    """Chains of near copies, texts around one passage, short and empty texts, exact copies."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []

    def add(text):
        rows.append((len(rows) * 3 + 1, text))

    source = [r.choice(words) for _ in range(90)]
    passage = " ".join(r.choice(words) for _ in range(25))
    for k in range(25):
        copy = source[:]
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(90)] = f"x{k}{r.random()}"
        add(" ".join(copy))
    chain = source[:60]
    for k in range(12):
        chain = chain[:]
        chain[5 * k % 60] = f"c{k}"
        add(" ".join(chain))
    for k in range(25):
        add(passage + " " + " ".join(f"p{k}a{i}" for i in range(r.randrange(0, 60))))
    for text in ("one two", "One  two", "one two three four five", "", " \n", "one", "aé b\n c\td e", "Aé b c d e"):
        add(text)
    rows += [(None, rows[0][1]), (10_001, None), rows[3], (10_002, "only me"), (None, "nobody else")]
    return rows


@pytest.mark.parametrize("common", [50, 4])
def test_components_equal_all_pairs(frame, common):
    rows = family()
    found = ngram_join.similarity_components(frame(rows), common).collect()
    expected = brute(rows)
    assert len(found) == len(rows)
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in found if x.doc_id is not None} == {(d, *e) for d, e in expected.items()}
    nameless = {(x.n_shingles, x.component_id) for x in found if x.doc_id is None}
    assert nameless == {(expected[1][0], expected[1][1]), (1, None)}


def test_one_of_each_keeps_the_least_id(frame):
    rows = family()
    kept = ngram_join.one_of_each(frame([(*r, "x") for r in rows], "doc_id long, text string, n long".replace("n long", "n string")), 4)
    assert kept.columns == ["doc_id", "text", "n"]
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({e[1] for e in brute(rows).values()})


def test_empty_table_and_clashing_columns(frame):
    schema = "doc_id long, text string, n long, identity string, front string, token string"
    assert ngram_join.similarity_components(frame([], schema)).count() == 0
    one = ngram_join.similarity_components(frame([(1, "a b", 1, "i", "f", "t")], schema)).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in one] == [(1, 1, 1)]


def test_prefixes_of_similar_sets_meet_under_every_order():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(5, 80))
        a = np.unique(r.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(-(2**62), 2**62, int(r.integers(0, 4)))]))
        if not len(b):
            continue
        both = len(set(a.tolist()) & set(b.tolist()))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        assert ngram_join.similar(a, b) == linked
        meet = [bool(set(x.tolist()) & set(y.tolist())) for x, y in zip(ngram_join.later_prefixes(a, 3), ngram_join.later_prefixes(b, 3), strict=True)]
        assert all(meet) or not linked


def test_pairs_that_miss_under_one_order_go_before_their_texts_move(lm, frame):
    """Documents around one passage: those that meet under the main order only aren't compared."""
    rows = [(k, " ".join([f"s{j}" for j in range(9)] + [f"d{k}w{j}" for j in range(40)])) for k in range(30)]
    rows += [(100, " ".join(f"z{j}" for j in range(60))), (101, " ".join(f"z{j}" for j in range(58)))]
    docs = frame(rows)
    sets = ngram_join.stash(docs.mapInArrow(ngram_join._sets, ngram_join._SETS), "sets")
    every = [(a, b) for a, b in itertools.combinations([r[0] for r in rows], 2)]
    meeting = {tuple(r) for r in ngram_join._meeting_in_all(sets, frame(every, "hub long, id long")).collect()}
    assert (100, 101) in meeting and len(meeting) < len(every) / 2
    linked = {tuple(sorted(r)) for r in ngram_join._links(docs, sets, frame(every, "hub long, id long")).collect()}
    assert linked == {(100, 101)}


def test_components_of_a_long_path_and_a_star(frame):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    found = {r.id: r.component for r in components.components(frame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(50)}
