"""Toxicity on held-out documents, and its automaton against edit distances."""

import itertools
import random

from cardwatch.llm import base, toxicity
from cardwatch.llm.lexicon_automaton import LexiconAutomaton


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(0)
    entries = [("abba", False, 1), ("abc", True, 0), ("bcabc", False, 2), ("cab", False, 0), ("bbca", True, 1)]
    automaton = LexiconAutomaton(entries)
    words = ["".join(w) for n in range(7) for w in itertools.product("abc", repeat=n)] + ["".join(r.choice("abcd") for _ in range(9)) for _ in range(500)]
    for word in words:
        hits = []
        for k, (text, begins, most) in enumerate(entries):
            ends = range(len(word) + 1) if begins else [len(word)]
            d = min(distance(word[:e], text) for e in ends)
            if d <= most:
                hits.append((d, k))
        assert automaton.match(word) == min(hits, default=None), word


def test_held_out_documents(lm):
    sf = "/root/testdata/sf0.01"
    documents, labels, held = base.table(lm, sf, "documents"), base.table(lm, sf, "labels"), toxicity.fold(3, 1)
    model = toxicity.fit(documents, labels.where(~held))
    found = toxicity.scores(documents, model).withColumn("held", held).join(labels, "doc_id").where("held").collect()
    clean = [r.score < toxicity.THRESHOLD for r in found if r.toxic == 0]
    toxic = [r.score >= toxicity.THRESHOLD for r in found if r.toxic == 1]
    assert sum(clean) >= 0.97 * len(clean)
    assert sum(toxic) >= 0.7 * len(toxic)


MODEL = {"entries": [("moronic", False, 1, 6.0), ("skunk", True, 0, 6.0)], "intercept": -3.0, "slope": 3.0}


def test_misspelled_terms_and_beginnings_are_hits():
    text = "You MORONNIC skunkish thing, mornic! moron"
    hits = toxicity.find_hits(text, dict(MODEL))
    assert [(text[a:b].lower(), e) for a, b, _, e, _ in hits] == [("moronnic", 1), ("skunkish", 0), ("mornic", 1)]


def test_quotation_counts_less_than_abuse():
    model = dict(MODEL)
    direct = toxicity.score_of(toxicity.find_hits("you are moronic", model), model)
    for quoted in ('he used "so moronic a word" there', "> you are moronic", "she said moronic", "«moronic» in print"):
        assert 0.1 < toxicity.score_of(toxicity.find_hits(quoted, model), model) < direct
    assert toxicity.is_quoted('a "b" moronic "c"', 6, 13) is False


def corpus():
    r = random.Random(4)
    words = [f"word{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(120):
        text = " ".join(r.choice(words) + ("" if r.random() < 0.5 else f" own{chr(97 + k % 26)}{chr(97 + k // 26)}") for _ in range(40))
        rows.append((k, text + (" vileterm" if k % 4 == 0 else ""), k % 4 == 0))
    return rows


def test_learned_term_and_a_group_of_copies(frame):
    rows = corpus()
    copies = [(1000 + k, "vileterm odd phrase of one family " + rows[0][1], True) for k in range(40)]
    docs = frame([r[:2] for r in rows + copies])
    model = toxicity.fit(docs, frame([(d, int(t)) for d, _, t in rows + copies], "doc_id long, toxic int"))
    assert [e[0] for e in model["entries"]] == ["vileterm"]
    found = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.scores(docs, model).collect()}
    assert found == {d: t for d, _, t in rows + copies}
    kept = toxicity.clean_rows(docs, model)
    assert {r.doc_id for r in kept.collect()} == {d for d, _, t in rows if not t}


def test_edge_cases(frame):
    docs = frame([(1, None, "x"), (None, "", "y"), (2, "a vileterm", "z"), (2, "a vileterm", "z")], "doc_id long, text string, score string")
    for labels in ([], [(1, 0)], [(2, 1), (2, 1)], [(2, None), (None, 1)]):
        model = toxicity.fit(docs, frame(labels, "doc_id long, toxic int"))
        found = toxicity.scores(docs, model).collect()
        assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
        assert toxicity.clean_rows(docs, model).columns == docs.columns
    assert toxicity.scores(frame([]), MODEL).collect() == []


def test_a_term_that_clean_documents_quote_is_learned(frame):
    rows = corpus()
    # One clean document in 18 reports the term.
    rows = [(d, t + (' they said "vileterm" there' if k % 20 == 1 else ""), y) for k, (d, t, y) in enumerate(rows)]
    assert 3 <= sum("vileterm" in t for _, t, y in rows if not y)
    docs = frame([r[:2] for r in rows])
    model = toxicity.fit(docs, frame([(d, int(y)) for d, _, y in rows], "doc_id long, toxic int"))
    assert "vileterm" in {e[0] for e in model["entries"]}
    found = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.scores(docs, model).collect()}
    assert found == {d: y for d, _, y in rows}


def test_digits_and_symbols_inside_a_term_are_edits():
    model = {"entries": [("idiot", False, 1, 6.0), ("scum", False, 1, 6.0), ("skunk", True, 0, 6.0)], "intercept": -3.0, "slope": 3.0}
    text = "You id1ot, i_diot! s*um, sc.um @t 3rd skunk-like x1y2z3 _scum_ $cum"
    hits = toxicity.find_hits(text, model)
    assert [(text[a:b], e) for a, b, _, e, _ in hits] == [
        ("id1ot", 1), ("diot", 1), ("s*um", 1), ("sc.um", 1), ("skunk", 0), ("scum", 0), ("cum", 1)
    ]


def test_short_terms_may_have_an_edit_where_clean_documents_allow_it(frame):
    rows = [(d, t.replace("vileterm", "scum"), y) for d, t, y in corpus()]
    labels = frame([(d, int(y)) for d, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame([r[:2] for r in rows]), labels)
    assert [toxicity.find_hits(t, model) != [] for t in ("scumm", "sccum", "sc0m")] == [True] * 3
    near = [(d, t if y else t + " scam", y) for d, t, y in rows]
    model = toxicity.fit(frame([r[:2] for r in near]), labels)
    assert toxicity.find_hits("scam", model) == [] != toxicity.find_hits("scum", model)


def test_every_entry_that_matches_is_told():
    automaton = LexiconAutomaton([("scum", False, 1), ("slum", False, 1), ("sc", True, 0)])
    assert automaton.match_all("scum") == {0: 0, 1: 1, 2: 0}
    assert automaton.match_all("sum") == {0: 1, 1: 1}


def test_ids_with_both_labels_and_repeated_labels(frame):
    """Whatever the order of rows, an id with both labels teaches nothing and a repeated one counts once."""
    docs = frame([(k, f"own words of the document number {k} and nothing else {k * k}") for k in range(6)])
    labels = [(0, 1), (1, 0), (2, 1), (2, 0), (3, 0), (3, 0), (4, None), (5, 1), (None, 1)]
    for rows in (labels, labels[::-1], labels * 2):
        sample = toxicity.training_sample(docs, frame(rows, "doc_id long, toxic int"), "toxic")
        assert sorted((r.text.split()[6], r.y) for r in sample.collect()) == [("0", 1), ("1", 0), ("3", 0), ("5", 1)]
