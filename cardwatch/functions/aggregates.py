"""Aggregate columns over rule results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def all_true(value: Column, item_id: Column) -> Column:
    """True unless a result is false; results without an item id are skipped."""
    return F.coalesce(F.bool_and(F.when(item_id.isNotNull(), value)), F.lit(True))


def any_true(value: Column, item_id: Column) -> Column:
    """True when some result is true; results without an item id are skipped."""
    return F.coalesce(F.bool_or(F.when(item_id.isNotNull(), value)), F.lit(False))


def count_when(condition: Column) -> Column:
    """Rows for which the condition holds; null counts as not holding."""
    return F.count(F.when(condition, F.lit(1)))


def combined(first: Column, second: Column) -> Column:
    """Two result lists as one."""
    return F.concat(first, second)


def deducted(results: Column, gone: Column) -> Column:
    """A result list without the results in the second list, repeats kept."""
    return F.filter(results, lambda r: ~F.array_contains(gone, r))


# --- aggregates of one's own ----------------------------------------------------

def exact(value: str) -> str:
    """SQL for an amount whose sums don't depend on their order and lose nothing when parts are taken away again."""
    return f"cast({value} as decimal(38,12))"


@dataclass(frozen=True)
class Aggregate:
    """An aggregate that can take back what it has added, given by what it keeps and what it says.

    ``fields`` are the state: for each, SQL over a row for what the row adds (null adds
    nothing). ``finish`` is SQL over the fields. The rest follows: an empty state is zero in
    every field (create), a row adds its values (accumulate), states add up (combine), and a
    part is subtracted from a whole (deduct). Every step is a sum, so Spark folds rows before
    it shuffles them, and a window needs what enters and what leaves, not all it holds.
    """

    fields: Mapping[str, str]
    finish: str

    def create(self) -> list[Column]:
        return [F.lit(0).alias(name) for name in self.fields]

    def accumulate(self) -> list[Column]:
        """Aggregate columns over rows."""
        return [F.coalesce(F.sum(F.expr(text)), F.lit(0)).alias(name) for name, text in self.fields.items()]

    def combine(self) -> list[Column]:
        """Aggregate columns over states."""
        return [F.sum(name).alias(name) for name in self.fields]

    def deduct(self, whole: str, part: str) -> list[Column]:
        """The state ``whole`` without the state ``part`` (structs; a null part is empty)."""
        return [
            (F.col(f"{whole}.{name}") - F.coalesce(F.col(f"{part}.{name}"), F.lit(0))).alias(name) for name in self.fields
        ]

    def finished(self, name: str) -> Column:
        return F.expr(self.finish).alias(name)


def fold(rows: DataFrame, keys: Sequence[str | Column], aggregate: Aggregate) -> DataFrame:
    """The state of every group of rows."""
    return rows.groupBy(*keys).agg(*aggregate.accumulate())


def merge(states: DataFrame, keys: Sequence[str | Column], aggregate: Aggregate) -> DataFrame:
    """States of the same group as one."""
    return states.groupBy(*keys).agg(*aggregate.combine())


def without(whole: DataFrame, part: DataFrame, keys: Sequence[str], aggregate: Aggregate) -> DataFrame:
    """Each group's state without that part of it, where there is one."""
    state = F.struct(*aggregate.fields)
    left = whole.select(*keys, state.alias("whole"))
    right = part.select(*keys, state.alias("part"))
    return left.join(right, list(keys), "left").select(*keys, *aggregate.deduct("whole", "part"))


# Fixed aggregates of the bank. A boolean without item id is skipped.
AVERAGE_AMOUNT = Aggregate({"total": exact("amount"), "n": "if(amount is null, 0, 1)"}, "try_divide(cast(total as double), n)")
ALL_TRUE = Aggregate({"n_false": "if(item_id is not null and not passed, 1, 0)"}, "n_false = 0")
ANY_TRUE = Aggregate({"n_true": "if(item_id is not null and passed, 1, 0)"}, "n_true > 0")
