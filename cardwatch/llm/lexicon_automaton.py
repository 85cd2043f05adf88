"""Levenshtein automata intersected with a lexicon trie, made deterministic as words ask for it.

A state is a set of (trie node, edits so far). Reading a character follows the trie
(match), stays (inserted character), or follows any child (replaced); skipped lexicon
characters are closed over. A branch ends once its edits exceed what any entry below its
node allows, so most words stop after a few characters.
"""

from __future__ import annotations

from collections.abc import Sequence


class LexiconAutomaton:
    """entries: (text, is_beginning, allowed edits). A beginning may be followed by anything."""

    def __init__(self, entries: Sequence[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed = [-1]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]
        for k, (text, is_beginning, edits) in enumerate(entries):
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(-1)
                    self.ends.append([])
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            self.ends[node].append((k, is_beginning, edits))
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.at_end: list[tuple[int, int] | None] = []
        self.at_once: list[tuple[int, int] | None] = []
        self.hits: list[list[tuple[int, int, bool]]] = []
        self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        todo = list(edits)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = edits[node] + 1
                if e <= self.allowed[child] and e < edits.get(child, 1 << 30):
                    edits[child] = e
                    todo.append(child)
        if not edits:
            return -1
        key = frozenset(edits.items())
        if key not in self.ids:
            hits = [(e, k, begins) for node, e in edits.items() for k, begins, most in self.ends[node] if e <= most]
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.hits.append(hits)
            self.at_end.append(min(((e, k) for e, k, _ in hits), default=None))
            self.at_once.append(min(((e, k) for e, k, begins in hits if begins), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.allowed[node]:
                edits[node] = min(e + 1, edits.get(node, 1 << 30))
            for label, child in self.children[node].items():
                cost = e if label == c else e + 1
                if cost <= self.allowed[child]:
                    edits[child] = min(cost, edits.get(child, 1 << 30))
        found = self._state(edits)
        self.next[state][c] = found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) with the fewest edits, or None."""
        state, best = 0, None
        following, at_once = self.next, self.at_once
        for c in word:
            to = following[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return best
            state = to
            if at_once[state] is not None and (best is None or at_once[state] < best):
                best = at_once[state]
        if self.at_end[state] is not None and (best is None or self.at_end[state] < best):
            best = self.at_end[state]
        return best

    def match_all(self, word: str) -> dict[int, int]:
        """entry -> fewest edits, of every entry that matches."""
        state, found = 0, {}
        for place in range(len(word) + 1):
            for e, k, begins in self.hits[state]:
                if begins or place == len(word):
                    found[k] = min(e, found.get(k, e))
            if place < len(word):
                to = self.next[state].get(word[place])
                state = self._step(state, word[place]) if to is None else to
                if state < 0:
                    break
        return found
