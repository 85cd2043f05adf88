"""Repeatable random draws: every draw is a function of the item id.

A fixed seed per rule gives every rule the same sequence, so by default all
score rules of one item share one Gaussian; a salt makes them independent.
"""

from __future__ import annotations

from cardwatch.functions.scalars import sql_double, sql_text

_HEX_DIGITS = 8


def _digest(item_id: str, salt: str) -> str:
    return f"md5(concat({item_id}, {sql_text(salt)}))" if salt else f"md5({item_id})"


def _number(digest: str, start: int) -> str:
    return f"bigint(conv(substr({digest}, {start}, {_HEX_DIGITS}), 16, 10))"


def _uniform(digest: str, start: int) -> str:
    """In (0, 1), never 0, so its logarithm exists."""
    return f"(({_number(digest, start)} + 0.5D) / {sql_double(float(16 ** _HEX_DIGITS))})"


def standard_normal(item_id: str, salt: str = "") -> str:
    """Box-Muller over two halves of the id's digest."""
    digest = _digest(item_id, salt)
    radius = f"sqrt(-2.0D * ln({_uniform(digest, 1)}))"
    return f"{radius} * cos(2.0D * pi() * {_uniform(digest, 1 + _HEX_DIGITS)})"


def score(normal: str, mean: float) -> str:
    """A draw around ``mean`` with a fifth of it as deviation."""
    return f"({normal}) * {sql_double(mean / 5)} + {sql_double(mean)}"


def percent_draw(item_id: str, salt: str = "") -> str:
    """A number from 0 to 99."""
    return f"{_number(_digest(item_id, salt), 1)} % 100"


def percent_true(item_id: str, percent: int, salt: str = "") -> str:
    return f"{percent_draw(item_id, salt)} < {percent}"
