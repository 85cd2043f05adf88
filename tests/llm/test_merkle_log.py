"""The Merkle manifest against a tree built level by level."""

import hashlib
import zlib

import pytest

from cardwatch.llm import merkle_log

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    result = [nodes]
    while len(result[-1]) > 1:
        last = result[-1]
        result.append([sha(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return result


def beside(tree, place):
    """(left, right) siblings per level."""
    steps = []
    for level in tree[:-1]:
        run = level[place // 16 * 16 : place // 16 * 16 + 16]
        steps.append((run[: place % 16], run[place % 16 + 1 :]))
        place //= 16
    return steps


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, docs in by_source.items():
        docs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = levels([leaf_of(r) for r in docs])
    top = levels([trees[s][-1][0] for s in order])
    root, result = top[-1][0], []
    for k, s in enumerate(order):
        for place, row in enumerate(by_source[s]):
            steps = beside(trees[s], place) + beside(top, k)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf_of((*row[:4], lowered(row[4]))) if tampered else leaf_of(row)
            for left, right in steps:
                node = sha(*left, node, *right)
            proof = sha(*[h for left, right in steps for h in left + right])
            result.append((row[0], leaf_of(row), trees[s][-1][0], root, proof, node, node == root))
    return sorted(result, key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def docs_of(source, ids):
    return [(i, source, "en", i * 3, f"Text {i}" if i % 3 else f"text {i}") for i in ids]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_sizes_around_full_runs(frame, n):
    rows = docs_of("a", range(n)) + docs_of("b", range(1000, 1003))
    assert found(merkle_log.proofs(frame(rows, SCHEMA))) == brute(rows)


def test_three_rounds_with_small_spans(frame, monkeypatch):
    """Runs of two make a tall tree: eleven levels over one source, and many sources above."""
    for name, value in (("FAN", 2), ("SPAN", 4)):
        monkeypatch.setattr(merkle_log, name, value)
    rows = docs_of("hot", range(530)) + [r for s in range(9) for r in docs_of(f"s{s}", [2000 + s])]

    def pairs(nodes):
        result = [nodes]
        while len(result[-1]) > 1:
            result.append([sha(*result[-1][k : k + 2]) for k in range(0, len(result[-1]), 2)])
        return result

    got = found(merkle_log.proofs(frame(rows, SCHEMA)))
    sources = ["hot"] + [f"s{s}" for s in range(9)]
    roots = [pairs([leaf_of(r) for r in rows if r[1] == s])[-1][0] for s in sources]
    assert {g[3] for g in got} == {pairs(roots)[-1][0]}
    tampered = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and "T" in r[4]}
    assert {g[0] for g in got if not g[6]} == tampered


def test_nulls_ties_empty_and_long_texts(frame):
    rows = [
        (None, None, None, None, None), (None, "a", "en", 1, "x"), (1, None, "en", 1, ""), (5, "a", None, None, "UPPER é ÀB"),
        (5, "a", None, None, "UPPER é ÀB"), (5, "a", "de", 2, "other"), (-3, "é", "en", 0, "A"), (7, "Z", "en", 9, "Ab" * 60_000), (8, "", "en", 1, "e"),
    ]
    assert found(merkle_log.proofs(frame(rows, SCHEMA))) == brute(rows)


def test_tampering_is_found_exactly_where_a_letter_changed(frame):
    rows = docs_of("a", range(200))
    got = {r.doc_id: r.verified for r in merkle_log.proofs(frame(rows, SCHEMA)).collect()}
    changed = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0 and i % 3}
    assert changed and {i for i, good in got.items() if not good} == changed


def test_whole_proofs_fold_to_the_root(frame):
    rows = docs_of("a", range(40))
    row = merkle_log.proofs(frame(rows, SCHEMA), whole=True).where("doc_id = 17").first()
    assert hashlib.sha256(row.proof.encode()).hexdigest() == row.proof_sha256
    assert len(row.proof) == 64 * (15 + 2)


@pytest.mark.parametrize("n", [1, 5, 16, 33, 256, 259, 4099])
def test_positions_are_those_of_a_postorder_walk(n):
    height = merkle_log.tree_height(n)
    log = merkle_log.append([bytes([k % 251]) * 32 for k in range(n)], height)
    places = {merkle_log.position(l, k, n, height) for l, c in enumerate(merkle_log.level_counts(n, height)) for k in range(c)}
    assert places == set(range(len(log)))
    assert log[merkle_log.position(height, 0, n, height)] == log[-1]
    if n > 16:
        assert merkle_log.node_of([bytes([k]) * 32 for k in range(16)]) == log[merkle_log.position(1, 0, n, height)]


def test_log_has_every_node_at_its_position(frame):
    rows = docs_of("a", range(300)) + docs_of("b", range(400, 403))
    log = merkle_log.Manifest(frame(rows, SCHEMA)).log().collect()
    for source, count in (("a", 300 + 19 + 2 + 1), ("b", 4)):
        mine = sorted((r.position, bytes(r.digest).hex()) for r in log if r.tree == "s" + source)
        assert [p for p, _ in mine] == list(range(count))
        assert mine[-1][1] == levels([leaf_of(r) for r in rows if r[1] == source])[-1][0]


def test_empty_table_and_further_columns(lm, frame):
    assert merkle_log.proofs(frame([], SCHEMA)).count() == 0
    rows = docs_of("a", range(20))
    wide = lm.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", tree string, place int, node int")
    assert found(merkle_log.proofs(wide)) == brute(rows)
