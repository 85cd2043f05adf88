"""Evaluating an expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(rows: DataFrame, columns: dict[str, str], *more: Column) -> DataFrame:
    """Add columns that are evaluated once per row, whoever reads them.

    They come out of a generator, which filters and projections are not merged
    through. As plain columns their expressions would be repeated for every
    reader, and once more inside each filter on a verdict.
    """
    if not columns:
        return rows.select("*", *more)
    fields = ", ".join(f"'{name}', {text}" for name, text in columns.items())
    return rows.select("*", *more, F.expr(f"inline(array(named_struct({fields})))"))
