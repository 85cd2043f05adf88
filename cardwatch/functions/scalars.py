"""Scalar functions, all built from codegen-able expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from cardwatch.fixed_values import (
    ACCOUNT_STATUSES,
    APPROVED,
    CITY_GROUPS,
    EVALUATED_PREFIX,
    FRAUD_SCORE_CUTOFF,
    NO_REASON,
    NOT_EVALUATED,
    REJECTS_PREFIX,
    RISK_SCORES,
)


def padded_id(number: Column, digits: int) -> Column:
    """Decimal text, zero-filled to ``digits``; longer numbers are kept whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), F.lit("0"))


def parsed_id(text: Column, kind: str = "int") -> Column:
    """The number in an id, null when it is not one."""
    return text.try_cast(kind)


# Rule expressions are SQL text, so that rules are plain data.

def sql_text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float) -> str:
    return f"{value!r}D"


def deviation(average: str) -> str:
    """One fifth of the average, cut toward zero."""
    return f"if({average} >= 0, floor({average} / 5), ceil({average} / 5))"


def amount_risk(amount: str, average: str) -> str:
    """LOW within one deviation of the average, MEDIUM within two, else HIGH.

    Bounds belong to the band. Null when either side is unknown.
    """
    step = deviation(average)
    return (
        f"CASE WHEN {amount} BETWEEN {average} - {step} AND {average} + {step} THEN 'LOW'"
        f" WHEN {amount} BETWEEN {average} - 2 * {step} AND {average} + 2 * {step} THEN 'MEDIUM'"
        f" WHEN {amount} IS NOT NULL AND {average} IS NOT NULL THEN 'HIGH' END"
    )


def reputation_risk(reputation: str) -> str:
    return (
        f"CASE WHEN {reputation} BETWEEN 8 AND 10 THEN 'LOW'"
        f" WHEN {reputation} BETWEEN 0 AND 3 THEN 'HIGH' ELSE 'MEDIUM' END"
    )


def risk_score(risk: str) -> str:
    scores = " ".join(f"WHEN '{name}' THEN {score}" for name, score in RISK_SCORES.items())
    return f"CASE {risk} {scores} END"


def is_fraud_score(score: Column) -> Column:
    return score >= FRAUD_SCORE_CUTOFF


def within_credit(balance: str, amount: str, limit: str) -> str:
    """True unless the charge would take the balance above the limit."""
    return f"{balance} + {amount} <= {limit}"


def projected_balance(balance: Column, amount: Column) -> Column:
    return balance + amount


def city_group(city: Column) -> Column:
    """Number of the group of mutually close cities, null for an unknown city."""
    group = F.lit(None).cast("int")
    for number, members in enumerate(CITY_GROUPS):
        group = F.when(city.isin(*members), F.lit(number)).otherwise(group)
    return group


def is_near(city: Column, other: Column) -> Column:
    """Same city or in the same close group; false when a city is unknown.

    The close lists are symmetric and complete within a group, so comparing
    group numbers is the whole test and needs no join.
    """
    return F.coalesce(city_group(city) == city_group(other), F.lit(False))


def close_cities(city: Column) -> Column:
    """The other members of the city's group, null for an unknown city."""
    close = F.lit(None).cast("array<string>")
    for members in CITY_GROUPS:
        everyone = F.array(*[F.lit(m) for m in members])
        close = F.when(city.isin(*members), F.array_remove(everyone, city)).otherwise(close)
    return close


def qualified_ruleset(category: str, ruleset: str) -> str:
    return f"{category}:{ruleset}"


def qualified_rule(category: str, ruleset: str, rule: str) -> str:
    """Rule names follow their set's qualified name without a separator."""
    return qualified_ruleset(category, ruleset) + rule


def reason_or_default(reason: Column) -> Column:
    return F.coalesce(reason, F.lit(NO_REASON))


def six_decimals(value: Column) -> Column:
    """Rounded for display, in plain double arithmetic: ``round`` goes through decimals."""
    return F.rint(value * 1e6) / 1e6


def enum_name(ordinal: Column, names: Sequence[str] = ACCOUNT_STATUSES) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), ordinal.cast("int"))


def enum_ordinal(name: Column, names: Sequence[str] = ACCOUNT_STATUSES) -> Column:
    position = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(position > 0, (position - 1).cast("int"))


def elapsed_text(millis: Column) -> Column:
    """``HH:MM:SS.mmm``; hours wrap at a day, as a clock does."""
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(millis / 3_600_000) % 24,
        F.floor(millis / 60_000) % 60,
        F.floor(millis / 1000) % 60,
        millis % 1000,
    )


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def latency_millis(start: Column, stop: Column) -> Column:
    """Stop minus start, null when the clock ran backwards."""
    return F.when(stop >= start, stop - start)


def reject_metric_name(ruleset: Column) -> Column:
    """Metric path of a rule set's reject counter, with path-safe characters only."""
    safe = F.regexp_replace(ruleset, "[^A-Za-z0-9]+", "_")
    return F.concat(F.lit(REJECTS_PREFIX), safe)


def metric_line(name: Column, value: Column, epoch_seconds: Column) -> Column:
    """``name value seconds`` followed by one blank, as the text protocol expects."""
    return F.concat_ws(" ", name, value.cast("string"), epoch_seconds.cast("string"), F.lit(""))


def result_message(result: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit(EVALUATED_PREFIX), result.cast("string")), F.lit(NOT_EVALUATED)
    )


def throughput_text(items: Column, seconds: int) -> Column:
    return F.concat(F.floor(items / seconds).cast("string"), F.lit(" TPS"))


def is_rejected(outcome: Column) -> Column:
    return outcome != APPROVED


def account_text(number: Column, limit: Column, balance: Column, status: Column) -> Column:
    return F.concat_ws(
        " ", F.lit("Acct"), number, limit.cast("string"), balance.cast("string"), enum_name(status)
    )


def merchant_text(merchant_id: Column, average: Column) -> Column:
    return F.concat_ws(" ", F.lit("Merchant"), merchant_id, F.lit("avgTxn"), average.cast("string"))


def transaction_text(txn_id: Column, account: Column, merchant: Column, amount: Column) -> Column:
    none = F.lit("null")
    return F.concat_ws(
        " ",
        F.lit("Transaction"), F.coalesce(txn_id, none),
        F.lit("account"), F.coalesce(account, none),
        F.lit("merchant"), F.coalesce(merchant, none),
        F.lit("amount"), F.coalesce(amount.cast("string"), none),
    )
