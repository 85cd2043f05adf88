"""The older flows: fraud-then-credit waterfall, credit lists, odd/even split, monitor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.fixed_values import (
    APPROVED,
    CREDIT_LIMIT_RULE,
    PENDING,
    REJECTED_FOR_CREDIT,
    REJECTED_FOR_FRAUD,
)
from cardwatch.functions import scalars
from cardwatch.operators.enrich import with_account, with_active_rules, with_merchant
from cardwatch.operators.once import once


def fraud_score() -> str:
    return scalars.risk_score(scalars.amount_risk("amount", "merchant.avg_txn_amount"))


def credit_passed() -> Column:
    return F.expr(
        scalars.within_credit("account.balance", "amount", "account.credit_limit")
    )


def waterfall(transactions: DataFrame, merchants: DataFrame, accounts: DataFrame) -> DataFrame:
    """Score first; only items below the cutoff are checked for credit.

    A missing merchant, or a missing account once credit is checked, stops the
    flow: the item stays pending and names the error.
    """
    rows = with_account(with_merchant(transactions, merchants), accounts)
    rows = once(rows, {"fraud_result": fraud_score()})
    fraud = scalars.is_fraud_score(F.col("fraud_result"))
    rows = rows.withColumn("payment_result", F.when(~fraud, credit_passed()))
    passed = F.col("payment_result")
    status = (
        F.when(fraud, F.lit(REJECTED_FOR_FRAUD))
        .when(passed, F.lit(APPROVED))
        .when(~passed, F.lit(REJECTED_FOR_CREDIT))
        .otherwise(F.lit(PENDING))
    )
    error = (
        F.when(F.col("fraud_result").isNull(), F.lit("Merchant must be set"))
        .when(~fraud & passed.isNull(), F.lit("Account must be set"))
    )
    return rows.withColumns({"final_status": status, "error": error})


@dataclass(frozen=True)
class CreditRule:
    """A rule of the credit flow and the rows it takes, both as SQL over an item with its account."""

    name: str
    passes: str
    takes: str = "true"


def running_credit_rules() -> list[CreditRule]:
    """The credit limit for all payments, a reserve for larger ones, and a share of the limit for even items."""
    limit = scalars.within_credit("account.balance", "amount", "account.credit_limit")
    return [
        CreditRule(CREDIT_LIMIT_RULE, limit),
        CreditRule("CreditReserveRule", "account.balance + amount <= 0.9 * account.credit_limit", "amount >= 25"),
        CreditRule("LimitShareRule", "amount <= 0.01 * account.credit_limit", "pmod(cast(id as bigint), 2) = 0"),
    ]


def credit_results(transactions: DataFrame, accounts: DataFrame, active: DataFrame) -> DataFrame:
    """Credit rule results with the rules expected for each item."""
    rows = with_account(with_active_rules(transactions, active, "rule"), accounts)
    return rows.withColumns({
        "rule": F.lit(CREDIT_LIMIT_RULE),
        "evaluation_result": credit_passed(),
    })


def credit_entries(transactions: DataFrame, accounts: DataFrame, rules: Sequence[CreditRule], running: DataFrame) -> DataFrame:
    """One row per item and rule that takes it: what the rule adds to the item's result list.

    ``running`` names the rules that run, one row each; it says how many results an item may expect.
    """
    rows = with_account(with_active_rules(transactions, running, "rule"), accounts)
    entries = ", ".join(
        f"if({r.takes}, named_struct('rule', {scalars.sql_text(r.name)}, 'evaluation_result', {r.passes}), null)" for r in rules
    )
    return rows.select("id", "expected_rules", F.expr(f"inline(array({entries}))")).where("rule is not null")


def monitor(received: Column, expected: Column, decides: Column) -> Column:
    """INTERMEDIATE while results are missing, then the deciding result's outcome."""
    return (
        F.when(received < expected, F.lit("INTERMEDIATE"))
        .when(decides, F.lit(APPROVED))
        .when(~decides, F.lit(REJECTED_FOR_CREDIT))
        .otherwise(F.lit(PENDING))
    )


def is_even(item_id: Column) -> Column:
    return F.pmod(scalars.parsed_id(item_id, "bigint"), F.lit(2)) == 0


def odd_even(
    transactions: DataFrame, merchants: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Credit rule alone for odd ids, the whole waterfall for even ids.

    Both flows read the same enriched row, so the split is a choice per row and
    the items are scanned once.
    """
    rows = waterfall(transactions, merchants, accounts)
    even = is_even(F.col("id"))
    credit_only = monitor(F.lit(1), F.lit(1), credit_passed())
    return rows.where(even.isNotNull()).select(
        "id",
        F.when(even, F.lit("waterfall")).otherwise(F.lit("credit")).alias("flow"),
        F.when(even, F.col("final_status")).otherwise(credit_only).alias("final_status"),
    )
