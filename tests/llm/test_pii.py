"""Personal data against plain regular expressions, and the bootstrapping."""

import re

from cardwatch.llm import base, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_d@e.f x@y@z.com a@b-c@d.e .a@b.c..d@e.f 1.2.3.4.5.6.7.8 1.2.3.999 0001.2.3.4",
    "4111 1111-1111 1111 +1 (555) 123-4567. \U0001f600 +12345678 é@x.y a@é.b +1+4912345678901 \u0001a@b.co\u0001 12-34",
    "4111111111111111 4111111111111111 5500 0000 0000 0004 99999999999999999999 1  2 4012-8888-8888-1881-",
    "", None, "+", "@", "1" * 500 + ".2.3.4", "x" * 3000 + "@" + "a." * 300 + "b", "1 " * 2000,
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force(frame, lm, sf):
    docs = [(r.doc_id, r.text) for r in base.table(lm, sf, "documents").select("doc_id", "text").collect()]
    docs += [(-1 - k, t) for k, t in enumerate(TRICKY)] + [(None, "me@x.org")]
    found = {r.doc_id: [tuple(s) for s in r.base] for r in pii.personal_spans(frame(docs)).collect()}
    assert found == {d: brute(t) for d, t in docs}


def contexts():
    rows = [(k, f"please write to user{k}@mail.org now") for k in range(8)]
    rows += [(20, "please write to member-7781 now"), (21, "please write to nobody now"), (22, "serial number AB12345 here")]
    return rows


def test_contexts_of_seeds_find_unseen_identifiers(frame):
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.personal_spans(frame(contexts())).collect()}
    assert found[20] == [("id", 16, 27)]
    assert not any(spans for doc, spans in found.items() if doc != 20)


def test_trust_needs_enough_different_seeds(frame):
    copies = [(k, "please write to user1@mail.org now") for k in range(9)] + [(20, "please write to member-7781 now")]
    assert not any(r.found for r in pii.personal_spans(frame(copies)).collect())


def test_redaction_replaces_spans_and_keeps_columns(frame):
    rows = [(d, t, len(t), "x") for d, t in contexts()] + [(30, None, 0, "y"), (31, "", 0, "z"), (None, "a@b.org", 7, "w"), (3, contexts()[3][1], 34, "x")]
    out = pii.redact(frame(rows, "doc_id long, text string, n_chars long, base string"))
    assert out.columns == ["doc_id", "text", "n_chars", "base"]
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in found}
    assert by_id[3][1:3] == ("please write to [EMAIL] now", 27)
    assert by_id[20][1] == "please write to [ID] now"
    assert by_id[21][1] == "please write to nobody now"
    assert by_id[None][1] == "[EMAIL]" and by_id[30][1] is None


def test_overlapping_spans_become_one(frame):
    out = pii.redact(frame([(1, "call 4111111111111111 or 1.2.3.4@x.org, +49 1.2.3.4")]))
    assert out.first().text == "call [CARD] or [EMAIL], +49 [IP]"


def test_empty_table(frame):
    assert pii.personal_spans(frame([])).collect() == []
    assert pii.redact(frame([])).collect() == []


def test_found_identifiers_confirm_further_contexts(frame):
    rows = [(k, f"please write to user{k}@mail.org now") for k in range(60)]
    rows += [(100 + k, f"please write to member-77{k} now") for k in range(10)]
    # A context beside found identifiers only, and one beside what that one finds.
    rows += [(200 + k, f"our member no member-77{k} today") for k in range(10)] + [(300 + k, f"our member no card-55{k} today") for k in range(1)]
    rows += [(400, "some other no card-999 later")]
    found = {r.doc_id: [tuple(s) for s in r.found] for r in pii.personal_spans(frame(rows)).collect()}
    assert found[100] == [("id", 16, 26)] and found[200] == [("id", 14, 24)]
    assert found[300] == [("id", 14, 22)]
    assert found[400] == []


def test_a_context_without_a_letter_is_no_context(frame):
    """Bars of a table around cards and around numbers that are none."""
    rows = [(k, f"| 4111 1111 1111 1111 | {k}") for k in range(3)] + [(10 + k, f"| 555555555555444{k} |") for k in range(10)]
    rows += [(30 + k, f"| user{k}@mail.org |") for k in range(9)] + [(50, "| 1234567890123456 |")]
    assert not any(r.found for r in pii.personal_spans(frame(rows)).collect())
