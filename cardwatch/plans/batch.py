"""The registered batch queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.fixed_values import (
    AVERAGE_SLIDE_S,
    INTERNAL_COUNTERS,
    LOCATION_RULE_MEANS,
    LOCATION_RULESET,
    MERCHANT_RULESET,
    OUTCOMES,
)
from cardwatch.functions import aggregates, draws, scalars
from cardwatch.operators import enrich, metrics, retention, verdicts, waterfall, windows
from cardwatch.operators.rules import (
    Registry,
    credit_rules,
    default_registry,
    location_rules,
    merchant_rules,
    reputation_rule,
)
from cardwatch.plans import inputs
from cardwatch.session import work_dir
from cardwatch.sources import bank, replay, sinks, tables
from cardwatch.streaming import changing, flows

QUERIES: dict = {}


def registered(query):
    QUERIES[query.__name__] = query
    return query


# --- stored tables --------------------------------------------------------------

@registered
def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.sizes([
        ("account", bank.given(spark, sf, "customer")),
        ("merchant", bank.given(spark, sf, "supplier")),
        ("transaction", bank.given(spark, sf, "events")),
    ])


@registered
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return bank.account(spark, sf, "0000000042")


@registered
def multi_key_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return tables.lookup_many(
        bank.merchants(spark, sf), "id", bank.transactions(spark, sf), "merchant_id"
    )


@registered
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    return tables.lookup_missing(
        bank.merchants(spark, sf), "id", bank.transactions(spark, sf), "merchant_id"
    )


@registered
def key_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keys(bank.accounts(spark, sf), "acct_number")


@registered
def cyclic_replay(spark: SparkSession, sf: str) -> DataFrame:
    txns = bank.transactions(spark, sf).drop("event_type", "ts")
    size = bank.given(spark, sf, "events").agg(F.count(F.lit(1))).scalar()
    requested = F.floor(size * 5 / 2)
    return replay.cyclic(txns, requested, size)


# --- scalar functions -----------------------------------------------------------

@registered
def account_status_names(spark: SparkSession, sf: str) -> DataFrame:
    name = scalars.enum_name(F.col("acct_status"))
    return bank.accounts(spark, sf).select(
        "acct_number", name.alias("status"), scalars.enum_ordinal(name).alias("status_ordinal")
    )


@registered
def padded_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bank.transactions(spark, sf).select(
        "id", "acct_number", "merchant_id",
        scalars.parsed_id(F.col("merchant_id")).alias("merchant_number"),
    )


@registered
def amount_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.with_merchant(bank.transactions(spark, sf), bank.merchants(spark, sf))
    average = "merchant.avg_txn_amount"
    return rows.select(
        "id",
        F.expr(scalars.deviation(average)).cast("int").alias("deviation"),
        F.expr(scalars.amount_risk("amount", average)).alias("risk"),
    )


@registered
def reputation_risk(spark: SparkSession, sf: str) -> DataFrame:
    return bank.merchants(spark, sf).select(
        "id", F.expr(scalars.reputation_risk("reputation")).alias("risk")
    )


@registered
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.with_merchant(bank.transactions(spark, sf), bank.merchants(spark, sf))
    score = F.expr(waterfall.fraud_score())
    return rows.select("id", score.alias("score"), scalars.is_fraud_score(score).alias("is_fraud"))


@registered
def credit_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.with_account(bank.transactions(spark, sf), bank.accounts(spark, sf))
    projected = scalars.projected_balance(F.col("account.balance"), F.col("amount"))
    return rows.select(
        "id", "acct_number",
        F.round(projected, 2).alias("projected_balance"),
        waterfall.credit_passed().alias("passed"),
    )


@registered
def near_city(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.with_account(bank.transactions(spark, sf), bank.accounts(spark, sf))
    home = F.col("account.location")
    return rows.select(
        "id", "location", home.alias("home"),
        F.concat_ws("|", F.array_sort(scalars.close_cities(F.col("location")))).alias("close_cities"),
        scalars.is_near(F.col("location"), home).alias("is_near"),
    )


@registered
def near_last_location(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.near_last_location(
        bank.transactions(spark, sf), bank.accounts(spark, sf)
    ).select("id", "acct_number", "location")


@registered
def gaussian_scores(spark: SparkSession, sf: str) -> DataFrame:
    normal = F.expr(draws.standard_normal("id"))
    rows = bank.transactions(spark, sf).select("id", normal.alias("g"))
    return rows.select("id", *[
        F.round(F.expr(draws.score("g", mean)), 6).alias(f"score_{round(mean * 10)}")
        for mean in LOCATION_RULE_MEANS
    ])


@registered
def independent_scores(spark: SparkSession, sf: str) -> DataFrame:
    registry = Registry([location_rules(independent=True)])
    rows = verdicts.evaluate(bank.transactions(spark, sf), registry)
    verdict = F.col(verdicts.verdict_column(0))
    return rows.select(
        "id", scalars.six_decimals(verdict["result_double"]).alias("total"), verdict["outcome"].alias("outcome")
    )


@registered
def boolean_rule(spark: SparkSession, sf: str) -> DataFrame:
    return bank.transactions(spark, sf).select(
        "id",
        F.expr(draws.percent_draw("id")).alias("draw"),
        F.expr(draws.percent_true("id", 10)).alias("hit_10"),
    )


@registered
def display_texts(spark: SparkSession, sf: str) -> DataFrame:
    txns = bank.transactions(spark, sf).select(
        F.lit("transaction").alias("entity"),
        scalars.transaction_text(
            F.col("id"), F.col("acct_number"), F.col("merchant_id"), F.col("amount")
        ).alias("text"),
    )
    merchants = bank.merchants(spark, sf).select(
        F.lit("merchant").alias("entity"),
        scalars.merchant_text(F.col("id"), F.col("avg_txn_amount")).alias("text"),
    )
    accounts = bank.accounts(spark, sf).select(
        F.lit("account").alias("entity"),
        scalars.account_text(
            F.col("acct_number"), F.col("credit_limit"), F.col("balance"), F.col("acct_status")
        ).alias("text"),
    )
    return txns.unionByName(merchants).unionByName(accounts)


# --- rules, rule sets, routing --------------------------------------------------

def selective_registry() -> Registry:
    """The default sets plus credit rules that take only larger payments."""
    registry = default_registry()
    registry.add(credit_rules(selects="amount >= 25"))
    return registry


@registered
def routing(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.route(bank.transactions(spark, sf), selective_registry())


@registered
def selective_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Location rules switched off and credit rules on larger payments: some items stay pending."""
    registry = selective_registry()
    registry.disable(LOCATION_RULESET)
    registry.disable(MERCHANT_RULESET)
    rows = enrich.with_account(bank.transactions(spark, sf), bank.accounts(spark, sf))
    judged = verdicts.with_final(verdicts.evaluate(rows, registry), registry)
    return judged.select("id", "n_applicable", "final_status", "rejecting_ruleset")


@registered
def active_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every transaction with the rule sets that are running."""
    active = default_registry().to_df(spark).where("ruleset_enabled and rule_enabled")
    rows = enrich.with_active_rules(bank.transactions(spark, sf), active, "qualified_ruleset")
    return rows.select("id", F.concat_ws("|", "rules").alias("rules"), "expected_rules")


@registered
def location_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    registry = Registry([location_rules()])
    rows = verdicts.evaluate(bank.transactions(spark, sf), registry)
    verdict = F.col(verdicts.verdict_column(0))
    return rows.select(
        "id", verdict["ruleset"].alias("ruleset"), scalars.six_decimals(verdict["result_double"]).alias("total"),
        verdict["outcome"].alias("outcome"), verdict["reason"].alias("reason"),
    )


def _merchant_verdicts(spark: SparkSession, sf: str, registry: Registry) -> DataFrame:
    rows = enrich.with_merchant(bank.transactions(spark, sf), bank.merchants(spark, sf))
    verdict = F.col(verdicts.verdict_column(0))
    return verdicts.evaluate(rows, registry).select(
        "id", verdict["ruleset"].alias("ruleset"), verdict["result_risk"].alias("risk"),
        verdict["outcome"].alias("outcome"), verdict["reason"].alias("reason"),
    )


@registered
def merchant_rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _merchant_verdicts(spark, sf, Registry([merchant_rules()]))


@registered
def risk_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _merchant_verdicts(spark, sf, Registry([merchant_rules(reputation_rule())]))


@registered
def ruleset_results(spark: SparkSession, sf: str) -> DataFrame:
    """All rule-set results as rows."""
    return verdicts.as_rows(inputs.judged(spark, sf), default_registry(), "id").select(
        "id", "ruleset", scalars.six_decimals(F.col("result_double")).alias("result_double"),
        "result_risk", "outcome", "reason"
    )


@registered
def rule_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every single rule's result as a row."""
    rows = enrich.with_merchant(bank.transactions(spark, sf), bank.merchants(spark, sf))
    return verdicts.rule_tasks(rows, default_registry()).select(
        "item_id", "ruleset", "rule", F.round("result_double", 6).alias("result_double"), "result_risk"
    )


@registered
def evaluation_times(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation time per rule set, from taking an item to posting its result."""
    spent = scalars.latency_millis(F.col("t_executor"), F.col("posted_ms"))
    return inputs.postings(spark, sf).groupBy("ruleset").agg(
        F.count(F.lit(1)).alias("n_results"), F.sum(spent).alias("evaluation_ms")
    )


# --- assembly and final verdicts ------------------------------------------------

@registered
def final_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.judged(spark, sf).select(
        "id", "n_applicable", "final_status", "rejecting_ruleset", "rejecting_reason",
        "n_rejecting",
    )


@registered
def assembled_results(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.transform(
        F.array_sort(F.map_entries("results")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return inputs.assembled(spark, sf).select(
        "item_id", "n_applicable", "n_posted", F.concat_ws("|", entries).alias("results")
    )


@registered
def assembled_whole_results(spark: SparkSession, sf: str) -> DataFrame:
    """The assembled items, one row a set with all that the set posted."""
    rows = inputs.assembled_whole(spark, sf).select("item_id", "n_posted", F.explode("results").alias("ruleset", "r"))
    return rows.select(
        "item_id", "n_posted", "ruleset", "r.outcome", "r.reason",
        scalars.six_decimals(F.col("r.result_double")).alias("result_double"), "r.result_risk",
    )


@registered
def complete_items(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.complete(inputs.assembled(spark, sf)).select("item_id", "n_posted")


@registered
def pending_items(spark: SparkSession, sf: str) -> DataFrame:
    finished = verdicts.complete(inputs.assembled(spark, sf))
    return enrich.pending(
        bank.transactions(spark, sf), "id", finished, "item_id"
    ).select("id", "acct_number", "merchant_id", "amount")


@registered
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = inputs.judged(spark, sf).agg(*verdicts.counter_columns(default_registry()))
    return counted.withColumn(
        "fraud_rate", F.round(F.try_divide("rejected_fraud_events", "completions"), 6)
    )


@registered
def rejects_by_ruleset(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.rejects_by_ruleset(inputs.judged(spark, sf), default_registry())


@registered
def outcome_history(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written by outcome, and the outcome tables read back as one."""
    columns = ["id", "acct_number", "merchant_id", "amount", "final_status"]
    judged = inputs.judged(spark, sf).select(*columns)
    folder = work_dir(spark, "outcomes")
    sinks.write_outcomes(judged, folder)
    return sinks.history(*[sinks.read_outcome(spark, folder, o, judged.schema) for o in OUTCOMES])


@registered
def result_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = verdicts.result_lists(inputs.postings(spark, sf), inputs.ruleset_names())
    entries = F.transform(
        "results",
        lambda e: F.concat(e["ruleset"], F.lit("="), e["outcome"], F.lit("x"), e["copies"].cast("string")),
    )
    return lists.select(
        "item_id", "n_results", F.concat_ws("|", F.array_sort(entries)).alias("results")
    )


@registered
def flattened_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result lists back to one row per distinct result."""
    lists = verdicts.result_lists(inputs.postings(spark, sf), inputs.ruleset_names())
    return lists.select("item_id", F.inline("results"))


@registered
def deducted_results(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's two rule outcomes combined, and what is left without the approvals."""
    verdict = [F.col(verdicts.verdict_column(n))["outcome"] for n in (0, 1)]
    rows = inputs.judged(spark, sf).withColumn(
        "both", aggregates.combined(F.array(verdict[0]), F.array(verdict[1]))
    )
    left = aggregates.deducted(F.col("both"), F.array(F.lit("Approved")))
    return rows.select(
        "id", F.concat_ws("|", "both").alias("combined"), F.concat_ws("|", left).alias("left_over")
    )


@registered
def all_true(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.account_results(spark, sf).groupBy("acct_number").agg(
        aggregates.all_true(F.col("passed"), F.col("item_id")).alias("all_true")
    )


@registered
def any_true(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.account_results(spark, sf).groupBy("acct_number").agg(
        aggregates.any_true(F.col("passed"), F.col("item_id")).alias("any_true")
    )


@registered
def running_all_true(spark: SparkSession, sf: str) -> DataFrame:
    results = inputs.account_results(spark, sf)
    return verdicts.running_all_true(results, "acct_number", "item_id", "passed")


@registered
def running_all_true_of_account(spark: SparkSession, sf: str) -> DataFrame:
    """The same for one account, picked before its results are flattened."""
    results = inputs.results_of_account(spark, sf, "0000000042")
    return verdicts.running_all_true(results, "acct_number", "item_id", "passed")


@registered
def first_results(spark: SparkSession, sf: str) -> DataFrame:
    results = inputs.account_results(spark, sf)
    return verdicts.first_result(results, "acct_number", "item_id", "passed")


@registered
def distinct_rejecting_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The set of rule sets that rejected a payment of the account."""
    rejecting = inputs.judged(spark, sf).groupBy("acct_number").agg(*[
        F.max(F.when(scalars.is_rejected(F.col(verdicts.verdict_column(n))["outcome"]),
                     F.lit(s.qualified_name))).alias(f"set_{n}")
        for n, s in default_registry().active()
    ])
    names = F.array_compact(F.array(*[F.col(f"set_{n}") for n, _ in default_registry().active()]))
    return rejecting.select("acct_number", F.concat_ws("|", names).alias("rulesets"))


@registered
def result_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.with_account(bank.transactions(spark, sf), bank.accounts(spark, sf))
    large = F.col("amount") >= 25
    result = F.when(large, waterfall.credit_passed())
    return rows.select("id", scalars.result_message(result).alias("message"))


# --- older flows ----------------------------------------------------------------

@registered
def fraud_credit_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return waterfall.waterfall(
        bank.transactions(spark, sf), bank.merchants(spark, sf), bank.accounts(spark, sf)
    ).select("id", "fraud_result", "payment_result", "final_status", "error")


@registered
def credit_limit_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The credit flow: every rule appends its results to the lists of the items it takes, one batch a rule."""
    folder = work_dir(spark, "credit-lists")
    rules = waterfall.running_credit_rules()
    running = inputs.rule_names(spark, rules)
    for batch_id, rule in enumerate(rules):
        entries = waterfall.credit_entries(bank.transactions(spark, sf), bank.accounts(spark, sf), [rule], running)
        sinks.write_version(entries, folder, batch_id)
    return inputs.credit_lists(spark, folder)


@registered
def odd_even_split(spark: SparkSession, sf: str) -> DataFrame:
    return waterfall.odd_even(
        bank.transactions(spark, sf), bank.merchants(spark, sf), bank.accounts(spark, sf)
    )


@registered
def result_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """Items with all results approved or rejected by their first result, others intermediate."""
    seen = verdicts.first_outcomes(inputs.postings(spark, sf))
    status = waterfall.monitor(
        F.col("n_received"), F.col("n_expected"), ~scalars.is_rejected(F.col("first_outcome"))
    )
    return seen.select("item_id", "n_received", "n_expected", status.alias("status"))


# --- counters, latency, metrics -------------------------------------------------

@registered
def merchant_groups(spark: SparkSession, sf: str) -> DataFrame:
    return bank.transactions(spark, sf).agg(
        *metrics.merchant_group_columns(F.col("merchant_id"))
    )


@registered
def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.with_stage_times(bank.transactions(spark, sf), inputs.txn_number())
    return metrics.stage_latencies(rows).select(
        "id", "t_routed", "to_executor_ms", "to_aggregator_ms", "latency_ms", "clock_error"
    )


@registered
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.with_stage_times(bank.transactions(spark, sf), inputs.txn_number())
    return metrics.latency_summary(metrics.stage_latencies(rows))


@registered
def ruleset_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ruleset_throughput(inputs.postings(spark, sf))


@registered
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.with_stage_times(bank.transactions(spark, sf), inputs.txn_number())
    return metrics.run_summary(metrics.stage_latencies(rows))


@registered
def backlog_gauge(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.backlog(
        bank.transactions(spark, sf), verdicts.complete(inputs.assembled(spark, sf))
    )


@registered
def metric_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.snapshot(inputs.ticks(spark, sf), default_registry()).drop("is_count")


@registered
def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_lines(metrics.snapshot(inputs.ticks(spark, sf), default_registry()))


@registered
def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.series(inputs.ticks(spark, sf), default_registry())


def _rule_versions():
    """The usual rules, and from noon of the first day on without the location rules."""
    later = default_registry()
    later.disable(LOCATION_RULESET)
    return [("2024-01-01 00:00:00", default_registry()), ("2024-01-01 12:00:00", later)]


@registered
def verdicts_by_rules_version(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by the rules in force at the time of the payment, kept in and read from a table of rules."""
    table = changing.RuleTable(spark, work_dir(spark, "rules"))
    versions = _rule_versions()
    for number, (_, registry) in enumerate(versions):
        table.save(registry, number)
    read = [(start, table.load(number)) for number, (start, _) in enumerate(versions)]
    rows = changing.judged_by_time(bank.transactions(spark, sf), bank.merchants(spark, sf), read)
    return rows.select("id", "rules_version", "n_applicable", "final_status", "rejecting_ruleset")


@registered
def payment_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.payment_rate(metrics.tick_completions(inputs.timed_transactions(spark, sf)))


@registered
def dashboard_status(spark: SparkSession, sf: str) -> DataFrame:
    current = metrics.snapshot(inputs.ticks(spark, sf), default_registry(), time="tick_s")
    return metrics.dashboard(current)


@registered
def dashboard_panel(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.panel(inputs.timed(spark, sf), default_registry(), inputs.newest_time(spark, sf))


@registered
def ruleset_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-set counters found by name among all counters."""
    registry = default_registry()
    counters = verdicts.named_counters(inputs.judged(spark, sf), registry, INTERNAL_COUNTERS)
    return metrics.reject_counters(counters).select(
        "name", scalars.reject_metric_name(F.col("name")).alias("metric"), "value"
    )


# --- windows --------------------------------------------------------------------

@registered
def sliding_merchant_avg(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.shown(windows.sliding_average(windows.merchant_slices(bank.transactions(spark, sf))), "avg_amount")


# An aggregate that isn't built in: how payments spread, and how many of them are large.
SPREAD = aggregates.Aggregate(
    {
        "n": "if(amount is null, 0, 1)",
        "total": aggregates.exact("amount"),
        "squares": aggregates.exact("amount * amount"),
        "large": "if(amount >= 25, 1, 0)",
    },
    "named_struct("
    "'spread', sqrt(greatest(0D, cast(squares as double) - cast(total as double) * cast(total as double) / n) / n), "
    "'large_share', large / n)",
)


@registered
def sliding_merchant_spread(spark: SparkSession, sf: str) -> DataFrame:
    """An own aggregate over the sliding windows of each merchant."""
    txns = bank.transactions(spark, sf).where(F.col("merchant_id").isNotNull())
    number = windows.interval_number(F.col("ts"), AVERAGE_SLIDE_S).alias("slice")
    slices = aggregates.fold(txns, ["merchant_id", number], SPREAD)
    states = windows.sliding_states(slices, "merchant_id", SPREAD).select("*", SPREAD.finished("said"))
    return states.select(
        "merchant_id", (F.col("end_slice") * AVERAGE_SLIDE_S).alias("window_end_s"), "n",
        F.round("said.spread", 4).alias("spread"), F.round("said.large_share", 6).alias("large_share"),
    )


@registered
def spread_without_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Per account the state of all payments with the part of one kind of event taken back."""
    txns = bank.transactions(spark, sf)
    whole = aggregates.fold(txns, ["acct_number"], SPREAD)
    clicks = aggregates.fold(txns.where(F.col("event_type") == "click"), ["acct_number"], SPREAD)
    left = aggregates.without(whole, clicks, ["acct_number"], SPREAD).where("n > 0").select("*", SPREAD.finished("said"))
    return left.select(
        "acct_number", "n", F.round(F.col("total").cast("double"), 4).alias("total"), F.round("said.spread", 4).alias("spread")
    )


@registered
def tumbling_tps(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling_counts(bank.transactions(spark, sf))


@registered
def updated_merchants(spark: SparkSession, sf: str) -> DataFrame:
    txns = bank.transactions(spark, sf)
    now = txns.agg(windows.interval_number(F.max("ts"), AVERAGE_SLIDE_S)).scalar()
    averages = windows.current_average(windows.merchant_slices(txns), now)
    return inputs.shown(windows.updated_merchants(bank.merchants(spark, sf), averages), "avg_txn_amount")


@registered
def average_changes(spark: SparkSession, sf: str) -> DataFrame:
    averages = windows.average_runs(windows.merchant_slices(bank.transactions(spark, sf)))
    return inputs.shown(windows.average_changes(averages, bank.merchants(spark, sf)), "old_average", "new_average")


@registered
def asof_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Amount risk against the average in force at the payment, else the stored one."""
    txns = bank.transactions(spark, sf)
    return inputs.shown(flows.score_live(txns, windows.merchant_slices(txns), bank.merchants(spark, sf)), "average")


# --- keyed tables, retention, errors --------------------------------------------

@registered
def newest_per_account(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert with newest wins: each account's latest payment."""
    txns = bank.transactions(spark, sf).select(
        "acct_number", "id", "merchant_id", "amount", F.unix_millis("ts").alias("ts_ms")
    )
    return sinks.newest_per_key(txns, ["acct_number"], "ts_ms", "id")


@registered
def idle_retention(spark: SparkSession, sf: str) -> DataFrame:
    judged = inputs.judged(spark, sf).select("id", "final_status", "ts")
    rows = retention.not_idle(judged, "ts", inputs.newest_time(spark, sf))
    return rows.select("id", "final_status")


@registered
def newest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the 10,000 newest fraud rejections."""
    rejected = inputs.judged(spark, sf).where(F.col("final_status") == "RejectedForFraud")
    kept = retention.newest(rejected.select("id", "final_status", "ts"), 10_000, "ts", F.desc("id"))
    return kept.select("id", "final_status")


@registered
def newest_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the 100 newest approvals."""
    approved = inputs.judged(spark, sf).where(F.col("final_status") == "Approved")
    kept = retention.newest(approved.select("id", "final_status", "ts"), 100, "ts", F.desc("id"))
    return kept.select("id", "final_status")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    rows = enrich.with_account(
        enrich.with_merchant(bank.transactions(spark, sf), bank.merchants(spark, sf)),
        bank.accounts(spark, sf),
    )
    number = scalars.parsed_id(F.col("merchant_id"))
    return sinks.with_error(rows, {
        "malformed merchant id": number.isNull(),
        "unknown merchant": F.col("merchant.id").isNull(),
        "unknown account": F.col("account.acct_number").isNull(),
    })


@registered
def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).where(F.col("error").isNotNull()).select("id", "merchant_id", "error")


@registered
def error_log(spark: SparkSession, sf: str) -> DataFrame:
    version = F.struct("ts", "id")
    return sinks.last_errors(_checked(spark, sf), F.col("event_type"), version)
