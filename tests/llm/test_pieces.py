"""Encoding against a plain Viterbi, and exact round trips."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardwatch.llm import base, piece_codec, shared_arrays

VOCABULARY = piece_codec.read_vocabulary()
AUTOMATON = piece_codec.build_automaton(VOCABULARY)
BY_TEXT = {}
for _k in VOCABULARY["usable"]:
    BY_TEXT.setdefault(VOCABULARY["pieces"][_k], _k)


def brute(text):
    s, score, back = " " + text, [0.0], [None]
    for end in range(1, len(s) + 1):
        best = (-np.inf, None)
        for start in range(max(0, end - 48), end):
            k = BY_TEXT.get(s[start:end].encode())
            if k is not None and score[start] + VOCABULARY["scores"][k] > best[0]:
                best = (score[start] + VOCABULARY["scores"][k], (start, [k]))
        one = s[end - 1].encode()
        if one not in BY_TEXT and score[end - 1] + VOCABULARY["fallback"] > best[0]:
            best = (score[end - 1] + VOCABULARY["fallback"], (end - 1, [VOCABULARY["bytes"][b] for b in one]))
        score.append(best[0])
        back.append(best[1])
    out, end = [], len(s)
    while end:
        end, ids = back[end]
        out = ids + out
    return out


def encoded(texts):
    stop, ids = piece_codec.encode_texts(texts, AUTOMATON)
    bounds = [0, *stop.tolist()]
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


TEXTS = ["a▁b  c   \n\n d▁", "\U0001f600é日本語\x00\t x", " ", "  lead", "trail  ", "x" * 300, "日" * 50, "\n", "▁", " " * 40, "Hello world"]


def test_equals_plain_viterbi(lm, sf):
    texts = TEXTS + [r.text[:300] for r in base.table(lm, sf, "documents").select("text").limit(60).collect()]
    assert encoded(texts) == [brute(t) for t in texts]
    assert encoded(["", None]) == [[], []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_round_trip_of_any_text(texts):
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert piece_codec.decode_ids(ids, VOCABULARY) == text
        if text:
            assert ids == brute(text)


def test_whole_table_round_trip(lm, sf):
    both = piece_codec.decode(piece_codec.encode(base.table(lm, sf, "documents"), VOCABULARY), VOCABULARY)
    rows = both.collect()
    assert rows and all(r.decoded == r.text and r.n_tokens == len(r.token_ids) for r in rows)


def test_edge_cases(frame):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "a b", "z"), (3, "a b", "z"), (4, "q" * 30_000, "w")]
    out = piece_codec.encode(frame(rows, "doc_id long, text string, token_ids string"), VOCABULARY)
    assert out.columns == ["doc_id", "text", "n_tokens", "token_ids"]
    decoded = piece_codec.decode(out, VOCABULARY, "text2").collect()
    assert [r.text2 for r in decoded] == [r[1] for r in rows]
    assert [r.token_ids for r in decoded][:2] == [None, []]
    assert piece_codec.encode(frame([]), VOCABULARY).collect() == []


def _unbroken(kind, n, chance):
    letters = {"latin": "etaoinshrdlucmfw", "same": "a", "han": "日本語中文字符的是不了人我在有他这", "mixed": "abé日😀▁x0", "dots": ".", "period": "ababab"}[kind]
    return "".join(chance.choice(letters) for _ in range(n)) if kind != "period" else "abc" * (n // 3)


@pytest.mark.parametrize("kind", ["latin", "same", "han", "mixed", "dots", "period"])
def test_long_texts_without_spaces_equal_plain_viterbi(kind, monkeypatch):
    """Windows of a long part give what one pass gives, also where they must begin further back."""
    monkeypatch.setattr(piece_codec, "LONG", 200)
    monkeypatch.setattr(piece_codec, "STRETCH", 64)
    chance = random.Random(kind)
    for lead in (1, 20, 256):
        monkeypatch.setattr(piece_codec, "LEAD", lead)
        texts = [_unbroken(kind, n, chance) for n in (199, 200, 333, 2000)]
        assert encoded(texts) == [brute(t) for t in texts]


def test_long_texts_keep_the_pace():
    """A text of one word is no slower by far than a text of many."""
    chance = random.Random(1)
    long = _unbroken("latin", 200_000, chance)
    start = time.perf_counter()
    ids = encoded([long, _unbroken("han", 100_000, chance)])
    took = time.perf_counter() - start
    assert [piece_codec.decode_ids(i, VOCABULARY) for i in ids][0] == long
    assert took < 5


def test_workers_map_the_arrays(lm, tmp_path):
    held = shared_arrays.share(lm, {"a": np.arange(7, dtype=np.uint16), "b": np.array([[1.5, 2.5]])}, "test")
    read = held.load()
    assert read["a"].tolist() == list(range(7)) and read["b"].tolist() == [[1.5, 2.5]]
    assert not read["a"].flags.writeable


def test_unknown_ids_fail():
    with pytest.raises(IndexError):
        piece_codec.decode_ids([10**6], VOCABULARY)
