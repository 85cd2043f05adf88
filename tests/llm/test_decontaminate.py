"""Decontamination against windows compared one by one."""

import random
import re

import numpy as np
import pytest

from cardwatch.llm import base, decontaminate
from cardwatch.llm.fm_index import FMIndex

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            phrases.setdefault(tuple(w[k : k + 13]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                p = tuple(w[k : k + size])
                if p in phrases:
                    hit.update(range(k, k + size))
                    found |= phrases[p] - {None}
        out[doc] = (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def cases():
    r = random.Random(1)
    vocabulary = ["a", "b", "é", "d1"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 13, 14, 20])))) for k in range(12)]
    items += [(50, ""), (51, None), (52, "--"), (3, items[3][1]), (None, "b b b b b b")]
    docs = [(k, " ".join(r.choice([*vocabulary, "zz"]) for _ in range(r.randrange(0, 300)))) for k in range(30)]
    docs += [(100, None), (101, ""), (102, "x-A, " + items[1][1].upper()), (103, items[2][1] + " zz" * 400), (104, items[5][1] * 2)]
    return docs, items


@pytest.mark.parametrize("block", [10**6, 60])
def test_equals_brute_force(frame, block):
    docs, items = cases()
    found = decontaminate.contamination(frame(docs), frame(items, "item_id long, text string"), block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found} == brute(docs, items)
    clean = decontaminate.clean_rows(frame(docs), frame(items, "item_id long, text string"), block).collect()
    assert {r.doc_id for r in clean} == {d for d, e in brute(docs, items).items() if not e[3]}


def test_shards_give_what_one_shard_gives(frame, monkeypatch):
    docs, items = cases()
    known = decontaminate.phrases([(str(i), t) for i, t in items if t])
    all_words = [base.alnum_words(t) for _, t in docs]
    together = decontaminate._shard_hits(all_words, known)
    alone = [decontaminate._shard_hits([w], known) for w in all_words]
    assert together == ([s[0][0] for s in alone], [s[1][0] for s in alone])


def test_empty_tables_and_further_columns(frame):
    docs, bench = frame([(1, "a b", "x")], "doc_id long, text string, n_words string"), frame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(docs, bench).collect()] == [False]
    assert decontaminate.contamination(frame([]), bench).count() == 0
    assert decontaminate.clean_rows(docs, bench).columns == docs.columns


def test_index_finds_and_locates_every_occurrence():
    r = np.random.default_rng(0)
    runs = [list(r.integers(1, 4, int(r.integers(1, 40)))) for _ in range(20)] + [[1] * 50, [1] * 50]
    row = np.array([s for run in runs for s in [*run, 0]], np.int64)
    index = FMIndex(row, 3, step=7)
    for size in (1, 2, 5):
        pattern = r.integers(1, 4, size)
        which, low, high = index.search(pattern[None, ::-1].copy(), np.array([size]))
        expected = [k for k in range(len(row)) if list(row[k : k + size]) == list(pattern)]
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
        assert found == expected


@pytest.mark.parametrize("block", [10**6, 5])
def test_rows_of_one_id_or_none_keep_their_own_verdict(frame, block):
    hit, fine = "a b c d e f", "u v w x y z"
    docs = [(1, hit), (1, fine), (1, fine), (None, hit), (None, fine), (None, fine), (2, "g h i q r s")]
    bench = frame([(1, "a b c"), (2, "d e f"), (3, "g h i")], "item_id long, text string")
    found = decontaminate.contamination(frame(docs), bench, block).collect()
    assert sorted((r.doc_id or -1, r.n_hit, r.contaminated, r.n_items) for r in found) == sorted([(1, 6, True, 2), (1, 0, False, 0), (1, 0, False, 0), (-1, 6, True, 2), (-1, 0, False, 0), (-1, 0, False, 0), (2, 3, True, 1)])
    assert [[tuple(s) for s in r.spans] for r in found if r.n_hit == 6] == [[(0, 6)]] * 2
    kept = decontaminate.clean_rows(frame(docs), bench, block).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, fine), (-1, fine), (1, fine), (1, fine)]
