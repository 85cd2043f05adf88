"""Prepared inputs shared by the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import APPROVED, FRAUD_RULES, MERCHANT_RULESET, NO_REASON
from cardwatch.functions.scalars import parsed_id, qualified_ruleset, result_message
from cardwatch.operators import enrich, metrics, verdicts
from cardwatch.operators.rules import Registry, default_registry
from cardwatch.operators.waterfall import CreditRule, credit_passed
from cardwatch.sources import bank, sinks

MERCHANT_VERDICT = qualified_ruleset(FRAUD_RULES, MERCHANT_RULESET)


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns as a report shows them, to six digits; everything is computed and compared unrounded."""
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def txn_number():
    return parsed_id(F.col("id"), "bigint")


def judge(transactions: DataFrame, merchants: DataFrame, registry: Registry) -> DataFrame:
    """Stored or streamed transactions with verdicts and the final status."""
    rows = enrich.with_merchant(transactions, merchants)
    return verdicts.with_final(verdicts.evaluate(rows, registry), registry)


def judged(spark: SparkSession, sf_dir: str, registry: Registry | None = None) -> DataFrame:
    """Transactions with their merchant, every rule set's verdict and the final status."""
    return judge(
        bank.transactions(spark, sf_dir),
        bank.merchants(spark, sf_dir),
        registry or default_registry(),
    )


def timed(spark: SparkSession, sf_dir: str, registry: Registry | None = None) -> DataFrame:
    """Judged transactions with stage times and latencies."""
    rows = metrics.with_stage_times(judged(spark, sf_dir, registry), txn_number())
    return metrics.stage_latencies(rows)


def newest_time(spark: SparkSession, sf_dir: str):
    """The time of the newest transaction, read from the stored column alone."""
    return bank.given(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()


def timed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with stage times and latencies, not judged."""
    return metrics.stage_latencies(metrics.with_stage_times(bank.transactions(spark, sf_dir), txn_number()))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tick_counters(timed(spark, sf_dir), default_registry())


def post(evaluated: DataFrame, registry: Registry) -> DataFrame:
    """Rule-set results as separate rows, as executors would post them.

    Error events lose their merchant result, and signup events carry an earlier
    approval from before their merchant was known, which the real result replaces.
    """
    staged = metrics.with_stage_times(evaluated, txn_number())
    rows = verdicts.as_rows(staged, registry, "id", "ts", "event_type", "t_executor")
    merchant = F.col("ruleset") == MERCHANT_VERDICT
    known_late = merchant & (F.col("event_type") == "signup")
    copies = (
        F.when(known_late, F.array(F.lit(0), F.lit(1)))
        .when(merchant, F.array(F.lit(1)))
        .otherwise(F.array(F.lit(0)))
    )
    early = merchant & (F.col("copy") == 0)
    return (
        rows.where(~(merchant & (F.col("event_type") == "error")))
        .withColumn("copy", F.explode(copies))
        .select(
            F.col("id").alias("item_id"),
            "ts",
            "ordinal",
            "ruleset",
            "n_applicable",
            F.when(early, F.lit(APPROVED)).otherwise(F.col("outcome")).alias("outcome"),
            F.when(early, F.lit(NO_REASON)).otherwise(F.col("reason")).alias("reason"),
            "result_double",
            F.when(early, F.lit("LOW")).otherwise(F.col("result_risk")).alias("result_risk"),
            "t_executor",
            (F.col("t_executor") + F.col("ordinal") + F.col("copy")).alias("posted_ms"),
        )
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post(judged(spark, sf_dir), default_registry())


def ruleset_names(registry: Registry | None = None) -> list[str]:
    return [s.qualified_name for _, s in (registry or default_registry()).active()]


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.assemble_outcomes(postings(spark, sf_dir), ruleset_names())


def assembled_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled items with the whole result of every set."""
    fields = ("outcome", "reason", "result_double", "result_risk")
    return verdicts.assemble(postings(spark, sf_dir), ruleset_names(), fields, ("posted_ms", "ordinal"))


def rule_names(spark: SparkSession, rules: Sequence[CreditRule]) -> DataFrame:
    return spark.createDataFrame([(r.name,) for r in rules], "rule string")


def credit_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The result lists of the credit flow as text."""
    lists = sinks.read_lists(spark, folder, ["id", "expected_rules"], ["rule"], "results").select(
        "id", "expected_rules", "n_results", "results"
    )
    said = F.transform("results", lambda r: F.concat(r["rule"], F.lit(" "), result_message(r["evaluation_result"])))
    return lists.select("id", "expected_rules", "n_results", F.concat_ws("|", said).alias("results"))


def _credit_results(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    rows = enrich.with_account(transactions, accounts)
    return rows.select("acct_number", F.col("id").alias("item_id"), credit_passed().alias("passed"))


def account_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit rule result of every transaction, listed under its account."""
    return _credit_results(bank.transactions(spark, sf_dir), bank.accounts(spark, sf_dir))


def results_of_account(spark: SparkSession, sf_dir: str, acct_number: str) -> DataFrame:
    """The same of one account; both tables are read by their stored keys."""
    return _credit_results(
        bank.transactions_of(spark, sf_dir, acct_number), bank.account(spark, sf_dir, acct_number)
    )
