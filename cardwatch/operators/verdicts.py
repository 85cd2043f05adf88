"""From rule sets to outcomes: evaluation, routing, assembly, final verdicts.

``evaluate`` is the main path: all sets of an item are columns of one row, so no
shuffle is needed before the counters. ``assemble`` serves results that arrive
as separate rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.fixed_values import (
    APPROVED,
    OUTCOMES,
    PENDING,
    REJECTED_FOR_CREDIT,
    REJECTED_FOR_FRAUD,
)
from cardwatch.functions import scalars
from cardwatch.functions.aggregates import count_when
from cardwatch.operators.once import once
from cardwatch.operators.rules import Registry


def verdict_column(ordinal: int) -> str:
    return f"verdict_{ordinal}"


def applicable_count(registry: Registry) -> Column:
    """Number of rule sets the item has to pass."""
    applies = [f"int(coalesce({s.selects}, false))" for _, s in registry.active()]
    return F.expr(" + ".join(applies) or "0").alias("n_applicable")


def route(items: DataFrame, registry: Registry, key: str = "id") -> DataFrame:
    """One row per item and rule set that applies to it."""
    targets = ", ".join(
        f"if({s.selects}, named_struct('ordinal', {n}, 'ruleset', "
        f"{scalars.sql_text(s.qualified_name)}), null)"
        for n, s in registry.active()
    )
    return items.select(
        F.col(key).alias("item_id"),
        applicable_count(registry),
        F.expr(f"inline(array({targets}))"),
    ).where("ruleset IS NOT NULL")


def _shared(registry: Registry) -> dict[str, str]:
    return {name: text for _, s in registry.active() for name, text in s.shared.items()}


def evaluate(items: DataFrame, registry: Registry) -> DataFrame:
    """Add ``n_applicable`` and one verdict struct per active set, null where it does not apply."""
    active = registry.active()
    rows = once(items, _shared(registry), applicable_count(registry))
    rows = once(rows, {f"result_{n}": s.result() for n, s in active})
    return rows.select(
        *items.columns,
        "n_applicable",
        *[F.expr(s.verdict(n, f"result_{n}")).alias(verdict_column(n)) for n, s in active],
    )


def verdict_columns(registry: Registry) -> list[Column]:
    return [F.col(verdict_column(n)) for n, _ in registry.active()]


def as_rows(evaluated: DataFrame, registry: Registry, *keep: str) -> DataFrame:
    """One row per item and verdict."""
    verdicts = F.array(*verdict_columns(registry))
    rows = evaluated.select(*keep, "n_applicable", F.inline(verdicts))
    return rows.where("ruleset IS NOT NULL")  # sets that do not apply leave a null row


def rule_tasks(items: DataFrame, registry: Registry, key: str = "id") -> DataFrame:
    """One row per item and rule: the rule's own result in its kind's slot."""
    tasks = ", ".join(
        f"if({s.selects}, named_struct('ruleset', {scalars.sql_text(s.qualified_name)}, "
        f"'rule', {scalars.sql_text(rule.qualified_name(s.name))}, {s.slots(rule.result())}), null)"
        for _, s in registry.active() for rule in s.rules if rule.enabled
    )
    return once(items, _shared(registry)).select(
        F.col(key).alias("item_id"), F.expr(f"inline(array({tasks}))")
    ).where("ruleset IS NOT NULL")


def with_final(evaluated: DataFrame, registry: Registry) -> DataFrame:
    """Final status, the first rejecting set in registration order, and all rejecting sets.

    An item no set applies to never completes and stays pending, and so does one that
    lacks the verdict of a set that applies.
    """
    rejected = [
        (verdict_column(n), f"{verdict_column(n)}.outcome <> '{APPROVED}'")
        for n, _ in registry.active()
    ]
    if not rejected:
        return _without_sets(evaluated)

    def first(field: str, otherwise: str) -> str:
        choices = [f"if({bad}, {verdict}.{field}, null)" for verdict, bad in rejected]
        return f"coalesce({', '.join(choices)}, {otherwise})"

    names = ", ".join(
        f"if({bad}, array({verdict}.ruleset), cast(array() AS array<string>))"
        for verdict, bad in rejected
    )
    n_rejecting = " + ".join(f"int(coalesce({bad}, false))" for _, bad in rejected)
    final = first("outcome", f"'{APPROVED}'")
    n_verdicts = " + ".join(f"int({verdict} is not null)" for verdict, _ in rejected)
    return evaluated.select(
        "*",
        F.expr(f"if(n_applicable > 0 and {n_verdicts} >= n_applicable, {final}, '{PENDING}')").alias("final_status"),
        F.expr(first("ruleset", "null")).alias("rejecting_ruleset"),
        F.expr(first("reason", "null")).alias("rejecting_reason"),
        F.expr(f"concat({names})").alias("rejecting_rulesets"),
        F.expr(n_rejecting).alias("n_rejecting"),
    )


def _without_sets(evaluated: DataFrame) -> DataFrame:
    """With every rule set switched off, everything waits."""
    no_text = F.lit(None).cast("string")
    return evaluated.withColumns({
        "final_status": F.lit(PENDING),
        "rejecting_ruleset": no_text,
        "rejecting_reason": no_text,
        "rejecting_rulesets": F.array().cast("array<string>"),
        "n_rejecting": F.lit(0),
    })


def _rejects_of(verdicts: Sequence[Column], status: str) -> Column:
    hits = [
        F.when(v["outcome"] == status, F.lit(1)).otherwise(F.lit(0)) for v in verdicts
    ]
    return reduce(Column.__add__, hits, F.lit(0))


def counter_columns(registry: Registry) -> list[Column]:
    """Aggregates over evaluated rows with a final status.

    ``*_events`` count every rejecting set, ``rejected_txns`` every rejected item.
    """
    verdicts = verdict_columns(registry)
    completed = F.col("final_status") != PENDING
    return [
        count_when(completed).alias("completions"),
        count_when(F.col("final_status") == APPROVED).alias("approved"),
        F.coalesce(F.sum(_rejects_of(verdicts, REJECTED_FOR_FRAUD)), F.lit(0))
        .alias("rejected_fraud_events"),
        F.coalesce(F.sum(_rejects_of(verdicts, REJECTED_FOR_CREDIT)), F.lit(0))
        .alias("rejected_credit_events"),
        count_when(F.col("final_status").isin(REJECTED_FOR_FRAUD, REJECTED_FOR_CREDIT))
        .alias("rejected_txns"),
    ]


def _reject_counts(registry: Registry) -> list[Column]:
    return [
        count_when(scalars.is_rejected(F.col(verdict_column(n))["outcome"])).alias(f"n_{n}")
        for n, _ in registry.active()
    ]


def rejects_by_ruleset(evaluated: DataFrame, registry: Registry) -> DataFrame:
    """Reject count per set, counted in one pass without exploding the items."""
    counted = evaluated.agg(*_reject_counts(registry))
    pairs = F.array(*[
        F.struct(F.lit(s.qualified_name).alias("ruleset"), F.col(f"n_{n}").alias("n_rejects"))
        for n, s in registry.active()
    ])
    return counted.select(F.inline(pairs)).where(F.col("n_rejects") > 0)


def named_counters(evaluated: DataFrame, registry: Registry, internal: Mapping[str, str]) -> DataFrame:
    """All counters by name, from one pass: the internal ones, and the rejects of every set that has any.

    ``internal`` gives the column of ``counter_columns`` behind each internal name.
    """
    counted = evaluated.agg(*counter_columns(registry), *_reject_counts(registry))
    own = [F.struct(F.lit(name).alias("name"), F.col(column).alias("value")) for name, column in internal.items()]
    rejects = [
        F.when(F.col(f"n_{n}") > 0, F.struct(F.lit(s.qualified_name).alias("name"), F.col(f"n_{n}").alias("value")))
        for n, s in registry.active()
    ]
    return counted.select(F.inline(F.array_compact(F.array(*own, *rejects))))


def _newest_of_sets(
    postings: DataFrame, rulesets: Sequence[str], keys: Sequence[str], value: Column, newest: Callable[[Column], Column]
) -> DataFrame:
    """Per item ``n_applicable`` and the entries (key, value) of all sets that posted.

    The known sets are one aggregate each, so they fold to one row per item before the
    shuffle. A set that isn't known folds by its own name beside them; an item's list of
    those holds each name once.
    """
    named = [(name, F.col("ruleset") == name) for name in rulesets]
    other = F.when(F.col("ruleset").isin(list(rulesets)), F.lit("")).otherwise(F.coalesce("ruleset", F.lit(OTHER)))
    folded = postings.withColumn("other_set", other).groupBy(*keys, "other_set").agg(
        F.max("n_applicable").alias("n_applicable"),
        *[newest(F.when(of_set, value)).alias(f"posted_{n}") for n, (_, of_set) in enumerate(named)],
        newest(F.when(F.col("other_set") != "", value)).alias("posted_other"),
    )
    merged = folded.groupBy(*keys).agg(
        F.max("n_applicable").alias("n_applicable"),
        *[F.max(f"posted_{n}").alias(f"posted_{n}") for n, _ in enumerate(named)],
        F.array_sort(F.collect_list(F.when(
            F.col("other_set") != "", F.struct(F.col("other_set").alias("key"), F.col("posted_other").alias("value"))
        ))).alias("others"),
    )
    known = F.array_compact(F.array(*[
        F.when(F.col(f"posted_{n}").isNotNull(), F.struct(F.lit(name).alias("key"), F.col(f"posted_{n}").alias("value")))
        for n, (name, _) in enumerate(named)
    ]))
    return merged.select(*keys, "n_applicable", F.concat(known, "others").alias("entries"))


def _as_map(assembled: DataFrame, keys: Sequence[str], value: Callable[[Column], Column]) -> DataFrame:
    entries = F.transform("entries", lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value")))
    return assembled.select(
        *keys, "n_applicable", F.size("entries").alias("n_posted"), F.map_from_entries(entries).alias("results")
    )


def assemble(
    postings: DataFrame,
    rulesets: Sequence[str],
    fields: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str] = ("item_id",),
) -> DataFrame:
    """Collect results posted as rows into one row per item; a set's newest result counts.

    Needs columns ``item_id``, ``ruleset``, ``n_applicable``, ``fields`` and ``order``. The
    results are a map from the set's name to its whole result, of known and unknown sets.
    """
    stamped = F.struct(F.struct(*order).alias("at"), F.struct(*fields).alias("row"))
    return _as_map(_newest_of_sets(postings, rulesets, keys, stamped, F.max), keys, lambda v: v["row"])


def assemble_outcomes(
    postings: DataFrame,
    rulesets: Sequence[str],
    keys: Sequence[str] = ("item_id",),
    outcomes: Sequence[str] = OUTCOMES,
) -> DataFrame:
    """``assemble`` when only the outcomes matter, with a map of outcome names.

    Posting time and outcome share one number per set, so the newest outcome is a
    plain maximum and the aggregation stays hash based. Nothing posted is lost: a result
    of an outcome not listed reads ``Other``, and a set not listed goes by its own name.
    """
    assembled = _newest_of_sets(postings, rulesets, keys, posting_stamp(outcomes), F.max)
    return _as_map(assembled, keys, lambda v: stamped_outcome(v, outcomes))


def assembled_stream_outcomes(
    postings: DataFrame,
    rulesets: Sequence[str],
    keys: Sequence[str] = ("item_id",),
    outcomes: Sequence[str] = OUTCOMES,
) -> DataFrame:
    """``assemble_outcomes`` as the one aggregation a stream's state allows.

    Results of sets not listed count as posted under the one name ``Other``.
    """
    stamped = posting_stamp(outcomes)
    listed = F.col("ruleset").isin(list(rulesets))
    named = [(name, F.col("ruleset") == name) for name in rulesets] + [(OTHER, ~listed)]
    newest = [F.max(F.when(of_set, stamped)).alias(f"posted_{n}") for n, (_, of_set) in enumerate(named)]
    merged = postings.groupBy(*keys).agg(F.max("n_applicable").alias("n_applicable"), *newest)
    entries = F.array_compact(F.array(*[
        F.when(
            F.col(f"posted_{n}").isNotNull(),
            F.struct(F.lit(name).alias("key"), stamped_outcome(F.col(f"posted_{n}"), outcomes).alias("value")),
        )
        for n, (name, _) in enumerate(named)
    ]))
    return merged.select(
        *keys,
        "n_applicable",
        F.size(entries).alias("n_posted"),
        F.map_from_entries(entries).alias("results"),
    )


# What an outcome that is not listed, or a set without a name, is called.
OTHER = "Other"


def posting_stamp(outcomes: Sequence[str] = OUTCOMES) -> Column:
    """Posting time and outcome as one number that sorts by time first."""
    code = F.coalesce(scalars.enum_ordinal(F.col("outcome"), outcomes), F.lit(len(outcomes)))
    return F.col("posted_ms") * (len(outcomes) + 1) + code


def stamped_outcome(stamp: Column, outcomes: Sequence[str] = OUTCOMES) -> Column:
    return scalars.enum_name(F.pmod(stamp, F.lit(len(outcomes) + 1)), [*outcomes, OTHER])


def first_outcomes(postings: DataFrame) -> DataFrame:
    """Per item the number of different sets that posted and the earliest outcome.

    Repeats of a set fold first, so any number of sets can be told apart. Of results
    posted at the same time the set of the smaller number comes first.
    """
    earliest = F.min(F.struct("posted_ms", "ordinal", "outcome"))
    sets = postings.groupBy("item_id", "ruleset").agg(F.max("n_applicable").alias("n_applicable"), earliest.alias("first"))
    return sets.groupBy("item_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_received"),
        F.max("n_applicable").alias("n_expected"),
        F.min("first").alias("first"),
    ).select("item_id", "n_received", "n_expected", F.col("first.outcome").alias("first_outcome"))


def complete(assembled: DataFrame) -> DataFrame:
    """Items whose applicable sets have all posted."""
    done = (F.col("n_applicable") > 0) & (F.col("n_posted") >= F.col("n_applicable"))
    return assembled.where(done)


def result_lists(
    postings: DataFrame, rulesets: Sequence[str], outcomes: Sequence[str] = OUTCOMES
) -> DataFrame:
    """All results of an item, repeats kept as counts.

    Every listed (set, outcome) pair is one counter, so an item with very many repeated
    results folds to one row before the shuffle. Results of other sets or outcomes are
    counted by their own names beside them; the list is the pairs that occurred.
    """
    pairs = [(s, o) for s in rulesets for o in outcomes]
    listed = F.col("ruleset").isin(list(rulesets)) & F.col("outcome").isin(list(outcomes))
    named = F.struct(
        F.coalesce("ruleset", F.lit(OTHER)).alias("ruleset"), F.coalesce("outcome", F.lit(OTHER)).alias("outcome")
    )
    counted = postings.withColumn("other", F.when(~F.coalesce(listed, F.lit(False)), named)).groupBy("item_id", "other").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            count_when((F.col("ruleset") == s) & (F.col("outcome") == o)).alias(f"n_{i}")
            for i, (s, o) in enumerate(pairs)
        ],
    )
    entry = F.struct("other.ruleset", "other.outcome", F.col("n").alias("copies"))
    merged = counted.groupBy("item_id").agg(
        F.sum("n").alias("n_results"),
        *[F.max(f"n_{i}").alias(f"n_{i}") for i in range(len(pairs))],
        F.array_sort(F.collect_list(F.when(F.col("other").isNotNull(), entry))).alias("others"),
    )
    entries = F.array_compact(F.array(*[
        F.when(
            F.col(f"n_{i}") > 0,
            F.struct(
                F.lit(s).alias("ruleset"), F.lit(o).alias("outcome"), F.col(f"n_{i}").alias("copies")
            ),
        )
        for i, (s, o) in enumerate(pairs)
    ]))
    return merged.select("item_id", "n_results", F.concat(entries, "others").alias("results"))


def running_all_true(
    results: DataFrame, key: str, order: str, value: str, out: str = "all_true_so_far"
) -> DataFrame:
    """The all-true answer after each result of a key.

    A prefix is all true exactly while no false result has come yet, so the first
    false position per key (folded before its shuffle) decides every row and no
    key's rows are ever gathered in one task.
    """
    first_false = (
        results.where(~F.col(value))
        .groupBy(F.col(key).alias("false_key"))
        .agg(F.min(order).alias("first_false"))
    )
    joined = results.join(first_false, results[key] == first_false["false_key"], "left")
    so_far = F.col("first_false").isNull() | (F.col(order) < F.col("first_false"))
    return joined.withColumn(out, so_far).drop("false_key", "first_false")


def first_result(results: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The earliest result of each key decides."""
    return results.groupBy(key).agg(
        F.min_by(value, order).alias("first_result"), F.count(F.lit(1)).alias("n_received")
    )
