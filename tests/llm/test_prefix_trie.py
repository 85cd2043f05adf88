"""The conversation trie against brute force."""

import hashlib
import zlib

import pytest

from cardwatch.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    """Every node by its path, straight from the contract."""
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = None if c is None else c - (abs(c) % 100) * (1 if c >= 0 else -1)
        shared = own.get(base, [])[:h] if c is not None else []
        paths[c] = tuple(shared + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    least = {n: min((c for c in m if c is not None), default=None) for n, m in members.items()}
    kids = {n: [k for k in members if len(k) == len(n) + 1 and k[: len(n)] == n] for n in members}

    def total(node):
        leaves = 0 if kids[node] else 1
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for k in kids[node]:
            more = total(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    rows = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if c is not None and len(paths[c]) == len(node)))
        rows.append((
            least[node], len(node), least[node[:-1]] if node else None, len(m), len(kids[node]), *total(node),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def chat(conv, *texts):
    return [(conv, n, "user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(texts)]


def test_shared_beginnings_copies_and_turnless(frame):
    rows = chat(100, "a", "b", "c", "d", "e", "f", "g") + chat(101, "a", "b") + chat(102, "a", "b", "x", "é!")
    rows += chat(103, "q") + chat(104, "q") + chat(250, "a", "b", "c") + chat(0, "zz") + chat(-5, "a", "b", "c", "d", "e", "f")
    assert found(prefix_trie.trie(frame(rows, SCHEMA))) == brute(rows)


def test_nulls_in_every_column(frame):
    rows = chat(7, "a", "b", "c") + [(8, None, None, None), (8, 0, "user", None), (8, 1, None, "t"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    assert found(prefix_trie.trie(frame(rows, SCHEMA))) == brute(rows)


def test_repeated_turns_and_ties(frame):
    rows = chat(300, "a") * 3 + [(301, 1, "user", "y"), (301, 1, "assistant", "x"), (301, 0, "user", "")]
    assert found(prefix_trie.trie(frame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("band", [2, 3, 8])
def test_deep_conversations_over_several_rounds(frame, band):
    """Paths that fork far below the root, over three rounds of bands of 2."""
    turns = [f"t{n}" for n in range(30)]
    rows = chat(1000, *turns) + chat(1001, *turns[:17], "fork", *turns[18:25]) + chat(2000, *turns, "on") + chat(3000, *turns[:9])
    assert found(prefix_trie.trie(frame(rows, SCHEMA), band)) == brute(rows)


def test_long_list_of_ends_is_streamed(frame, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = [(c * 100, 0, "user", "same") for c in range(40)] + chat(50_000, "same", "more")
    assert found(prefix_trie.trie(frame(rows, SCHEMA))) == brute(rows)


def test_one_conversation_over_several_blocks(frame):
    """Running sums across blocks of a long conversation agree with those of a short block."""
    from cardwatch.llm import ranks

    rows = frame([(0, n, n * 7 % 5) for n in range(50)], "g int, n long, v long")
    got = {r.n: r.v for r in ranks.running_sums(rows, ["g"], "n", ["v"], block=8).collect()}
    assert got == {n: sum(k * 7 % 5 for k in range(n + 1)) for n in range(50)}


def test_empty_table_and_further_columns(lm, frame):
    assert prefix_trie.trie(frame([], SCHEMA)).count() == 0
    rows = chat(5, "a", "b")
    wide = lm.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", conv int, place int, k1 int")
    assert found(prefix_trie.trie(wide)) == brute(rows)
