"""Plain statistics of a whole text, for quality rules and scores."""

from __future__ import annotations

import numpy as np

# Characters that count as symbols, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
REPEAT_WORDS = 8

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
    "n_digits", "n_marks", "n_ended_lines", "n_distinct_words", "n_lone_marks", "n_long_words",
    "n_adjacent",
)


def repeated_words(words: list, window: int = REPEAT_WORDS) -> int:
    """Words inside windows that the text has twice or more, the first one included.

    Windows are compared exactly: equal runs of 2, 4 and 8 words get equal numbers.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict = {}
    run = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) > n - window:
        return 0
    width = 1
    while width < window:
        pair = run[:-width] * (n + 1) + run[width:]
        run = np.unique(pair, return_inverse=True)[1]
        width *= 2
    again = np.bincount(run)[run] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:-window] += again
    edge[window:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The numbers named in STATS; zeros for a null or empty text."""
    if not text:
        return (0,) * len(STATS)
    data = text.encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    spaces = int(sum(counts[ord(c)] for c in SPACES))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    upper = sum(map(str.isupper, text)) if not text.isascii() else int(counts[65:91].sum())
    ascii_letters = int(counts[65:91].sum() + counts[97:123].sum())
    beyond = len(text) - int(counts[:128].sum())
    return (
        len(words),
        len(text) - spaces,
        int(sum(counts[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        ascii_letters + beyond,
        int(counts[48:58].sum()),
        int(counts[ord("!")] + counts[ord("?")]),
        sum(line.rstrip(SPACES)[-1] in ".!?…\"”»" for line in lines),
        len(set(words)),
        sum(len(w) == 1 and not w.isalnum() for w in words),
        sum(len(w) > 20 for w in words),
        sum(map(bytes.__eq__, words[1:], words)),
    )
