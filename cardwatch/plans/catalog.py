"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from cardwatch.plans import batch, oracle, streams


def queries() -> dict:
    return {**batch.QUERIES, **streams.QUERIES}


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {name: sql for name, sql in oracle.SQL.items() if name in known}
