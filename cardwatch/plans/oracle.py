"""Independent SQL for every registered query, written for DuckDB over the given tables."""

from __future__ import annotations

_CITIES = (
    "['Atlanta','Memphis','Orlando','Nashville','London','Edinburgh','Dublin','Paris',"
    "'Istanbul','Athens','Sofia','Ankara','San Francisco','Las Vegas','Los Angeles','Seattle']"
)

# Views over the given tables, then the verdicts of both rule sets.
_VIEWS = f"""
account AS (
  SELECT lpad(c_custkey::varchar, 10, '0') AS acct_number,
         1000.0::double * (1 + c_custkey % 10) AS credit_limit,
         c_acctbal AS balance, (c_custkey % 3)::smallint AS acct_status,
         {_CITIES}[(c_custkey % 16)::int + 1] AS location
  FROM customer),
merchant AS (
  SELECT lpad(s_suppkey::varchar, 8, '0') AS id,
         'Merchant' || lpad(s_suppkey::varchar, 8, '0') AS name,
         (s_suppkey % 11)::smallint AS reputation,
         [10.0::double, 25.0::double, 50.0::double, 100.0::double][(s_suppkey % 4)::int + 1] AS avg_txn_amount,
         {_CITIES}[(s_suppkey % 16)::int + 1] AS location
  FROM supplier),
txn AS (
  SELECT lpad(event_id::varchar, 14, '0') AS id, event_id AS n,
         lpad(user_id::varchar, 10, '0') AS acct_number,
         CASE WHEN event_id % 97 = 96 THEN NULL
              ELSE lpad((event_id % ((SELECT count(*) FROM supplier) + 1))::varchar, 8, '0') END AS merchant_id,
         value AS amount, {_CITIES}[(event_id % 16)::int + 1] AS location,
         ts, event_type, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000000 AS ts_s
  FROM events),
scored AS (
  SELECT t.*, m.id AS m_id, m.avg_txn_amount, m.reputation,
         a.balance, a.credit_limit, a.location AS home, a.acct_number AS a_id,
         CASE WHEN m.id IS NULL THEN NULL
              WHEN amount BETWEEN avg_txn_amount - trunc(avg_txn_amount / 5)
                              AND avg_txn_amount + trunc(avg_txn_amount / 5) THEN 'LOW'
              WHEN amount BETWEEN avg_txn_amount - 2 * trunc(avg_txn_amount / 5)
                              AND avg_txn_amount + 2 * trunc(avg_txn_amount / 5) THEN 'MEDIUM'
              ELSE 'HIGH' END AS amount_risk,
         CASE WHEN m.id IS NULL THEN NULL
              WHEN reputation BETWEEN 8 AND 10 THEN 'LOW'
              WHEN reputation BETWEEN 4 AND 7 THEN 'MEDIUM'
              WHEN reputation BETWEEN 0 AND 3 THEN 'HIGH' ELSE 'MEDIUM' END AS rep_risk,
         balance + amount <= credit_limit AS credit_ok,
         sqrt(-2 * ln((('0x' || substr(md5(t.id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))
           * cos(2 * pi() * ((('0x' || substr(md5(t.id), 9, 8))::bigint + 0.5::double) / 4294967296.0::double)) AS g
  FROM txn t LEFT JOIN merchant m ON t.merchant_id = m.id
             LEFT JOIN account a ON t.acct_number = a.acct_number),
judged AS (
  SELECT *, round(0.1*(1 + g/5) + 0.2*(1 + g/5) + 0.3*(1 + g/5) + 0.4*(1 + g/5) + 0.5*(1 + g/5), 6)::double AS loc_total,
         coalesce(amount_risk, 'LOW') AS m_risk,
         CASE WHEN 1.5 + 0.3 * g <= 1.0 THEN 'RejectedForFraud' ELSE 'Approved' END AS loc_outcome,
         CASE WHEN amount_risk = 'HIGH' THEN 'RejectedForFraud' ELSE 'Approved' END AS m_outcome,
         CASE WHEN 1.5 + 0.3 * g <= 1.0 THEN 'Sum of results exceeds threshold'
              ELSE 'No explanation' END AS loc_reason,
         CASE WHEN amount_risk = 'HIGH' THEN 'Rated as high risk by merchant rules'
              ELSE 'No explanation' END AS m_reason,
         CASE WHEN 1.5 + 0.3 * g <= 1.0 OR amount_risk = 'HIGH'
              THEN 'RejectedForFraud' ELSE 'Approved' END AS final_status,
         ts_ms AS t_routed, ts_ms + n % 20 AS t_executor, ts_ms + n % 20 + n % 35 AS t_aggregator,
         n % 20 + n % 35 AS latency_ms
  FROM scored),
posted AS (
  SELECT id AS item_id, 0 AS ordinal, 'FraudRules:LocationBasedRules' AS ruleset,
         loc_outcome AS outcome, t_executor AS posted_ms FROM judged
  UNION ALL
  SELECT id, 1, 'FraudRules:Merchant Rules', m_outcome, t_executor + 2 FROM judged WHERE event_type <> 'error'
  UNION ALL
  SELECT id, 1, 'FraudRules:Merchant Rules', 'Approved', t_executor + 1 FROM judged WHERE event_type = 'signup')
"""

# Window averages written out directly: every transaction joined to its 20 windows.
_WINDOWS = """
windowed AS (
  SELECT merchant_id, (ts_s // 5 + k) * 5 AS window_end_s,
         avg(amount) AS avg_amount, count(*) AS n_txns
  FROM txn, (SELECT unnest(generate_series(1, 20)) AS k)
  WHERE merchant_id IS NOT NULL GROUP BY ALL)
"""

_TICKS = """
per_tick AS (
  SELECT ts_s // 5 AS tick, count(*) AS done,
         sum((loc_outcome <> 'Approved')::int + (m_outcome <> 'Approved')::int) AS fraud,
         count(*) FILTER (try_cast(merchant_id AS int) BETWEEN 1 AND 9) AS amazon,
         count(*) FILTER (try_cast(merchant_id AS int) BETWEEN 10 AND 20) AS walmart,
         sum(latency_ms) AS lat,
         count(*) FILTER (loc_outcome <> 'Approved') AS rej_loc,
         count(*) FILTER (m_outcome <> 'Approved') AS rej_m
  FROM judged GROUP BY 1),
cumulative AS (
  SELECT tick, done AS interval_done, sum(done) OVER w AS done, sum(fraud) OVER w AS fraud,
         sum(amazon) OVER w AS amazon, sum(walmart) OVER w AS walmart, sum(lat) OVER w AS lat,
         sum(rej_loc) OVER w AS rej_loc, sum(rej_m) OVER w AS rej_m
  FROM per_tick WINDOW w AS (ORDER BY tick)),
metric AS (
  SELECT ((tick + 1) * 5)::bigint AS tick_s, name, value FROM (
    SELECT tick, unnest(['bib.fraud.rate','bib.payment.rate','bib.payments.all','bib.latency.avg',
                         'bib.payments.amazon','bib.payments.walmart',
                         'bib.rejectedby.FraudRules_LocationBasedRules','bib.rejectedby.FraudRules_Merchant_Rules']) AS name,
           unnest([round(fraud / done, 6)::double, interval_done / 5.0::double, done::double, round(lat / done, 6)::double,
                   amazon::double, walmart::double,
                   nullif(rej_loc, 0)::double, nullif(rej_m, 0)::double]) AS value
    FROM cumulative)
  WHERE value IS NOT NULL)
"""


def _over(*views: str, query: str) -> str:
    return "WITH " + ",".join((_VIEWS, *views)) + "\n" + query


def _plain(query: str) -> str:
    return _over(query=query)


_LAST_READING = "WHERE tick_s = (SELECT max(tick_s) FROM metric)"

# What a reading's values say where the text form matters.
_LINES = """
SELECT name || ' ' || value || ' ' || (SELECT max(ts_s) FROM txn) || ' ' AS line FROM (
  SELECT name, CASE WHEN name IN ('bib.fraud.rate','bib.payment.rate','bib.payments.all','bib.latency.avg')
                    THEN value::varchar ELSE value::bigint::varchar END AS value
  FROM metric WHERE tick_s = (SELECT max(tick_s) FROM metric))
"""

SQL = {
    "table_sizes": """
        SELECT 'account' AS table_name, count(*) AS n_rows FROM customer
        UNION ALL SELECT 'merchant', count(*) FROM supplier
        UNION ALL SELECT 'transaction', count(*) FROM events""",
    "point_lookup": _plain("SELECT * FROM account WHERE acct_number = '0000000042'"),
    "multi_key_fetch": _plain(
        "SELECT * FROM merchant WHERE id IN (SELECT merchant_id FROM txn WHERE merchant_id IS NOT NULL)"),
    "missing_keys": _plain("""
        SELECT DISTINCT merchant_id AS id FROM txn
        WHERE merchant_id IS NOT NULL AND merchant_id NOT IN (SELECT id FROM merchant)"""),
    "key_scan": "SELECT lpad(c_custkey::varchar, 10, '0') AS acct_number FROM customer",
    "cyclic_replay": _plain("""
        SELECT lpad(r.k::varchar, 14, '0') AS id, t.acct_number, t.merchant_id, t.amount, t.location
        FROM (SELECT unnest(range((SELECT (count(*) * 5) // 2 FROM events))) AS k) r
        JOIN txn t ON r.k % (SELECT count(*) FROM events) = t.n"""),
    "account_status_names": _plain("""
        SELECT acct_number, CASE acct_status WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'OVERDUE' ELSE 'CLOSED' END AS status,
               acct_status::int AS status_ordinal FROM account"""),
    "padded_ids": _plain("""
        SELECT id, acct_number, merchant_id, try_cast(merchant_id AS int) AS merchant_number FROM txn"""),
    "amount_risk": _plain(
        "SELECT id, trunc(avg_txn_amount / 5)::int AS deviation, amount_risk AS risk FROM scored"),
    "reputation_risk": _plain("""
        SELECT id, CASE WHEN reputation >= 8 AND reputation <= 10 THEN 'LOW'
                        WHEN reputation <= 3 AND reputation >= 0 THEN 'HIGH' ELSE 'MEDIUM' END AS risk
        FROM merchant"""),
    "risk_score": _plain("""
        SELECT id, CASE amount_risk WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 5 END AS score,
               CASE amount_risk WHEN 'HIGH' THEN true WHEN 'MEDIUM' THEN false WHEN 'LOW' THEN false END AS is_fraud
        FROM scored"""),
    "credit_check": _plain("""
        SELECT id, acct_number, round(balance + amount, 2) AS projected_balance, credit_ok AS passed FROM scored"""),
    "near_city": _plain(f"""
        , city AS (SELECT unnest({_CITIES}) AS name, unnest(range(16)) // 4 AS grp)
        SELECT s.id, s.location, s.home,
               (SELECT string_agg(o.name, '|' ORDER BY o.name) FROM city o
                WHERE o.grp = c.grp AND o.name <> c.name) AS close_cities,
               c.grp = h.grp AS is_near
        FROM scored s JOIN city c ON s.location = c.name JOIN city h ON s.home = h.name"""),
    "near_last_location": _plain(f"""
        , city AS (SELECT unnest({_CITIES}) AS name, unnest(range(16)) // 4 AS grp)
        SELECT s.id, s.acct_number, s.location
        FROM scored s JOIN city c ON s.location = c.name JOIN city h ON s.home = h.name
        WHERE c.grp = h.grp"""),
    "gaussian_scores": _plain("""
        SELECT id, round(0.1 + g * 0.02, 6)::double AS score_1, round(0.2 + g * 0.04, 6)::double AS score_2,
               round(0.3 + g * 0.06, 6)::double AS score_3, round(0.4 + g * 0.08, 6)::double AS score_4,
               round(0.5 + g * 0.1, 6)::double AS score_5 FROM scored"""),
    "independent_scores": _plain("""
        , drawn AS (
          SELECT id, p, md5(id || 'RandomDoubleRule' || p::varchar) AS d
          FROM txn, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::double[]) AS p)),
        totals AS (
          SELECT id, (sum(p + p / 5 * sqrt(-2 * ln((('0x' || substr(d, 1, 8))::bigint + 0.5::double) / 4294967296.0::double))
                 * cos(2 * pi() * ((('0x' || substr(d, 9, 8))::bigint + 0.5::double) / 4294967296.0::double)))) AS total
          FROM drawn GROUP BY id)
        SELECT id, round(total, 6) AS total, CASE WHEN total <= 1.0 THEN 'RejectedForFraud' ELSE 'Approved' END AS outcome FROM totals"""),
    "boolean_rule": _plain("""
        SELECT id, ('0x' || substr(md5(id), 1, 8))::bigint % 100 AS draw,
               ('0x' || substr(md5(id), 1, 8))::bigint % 100 < 10 AS hit_10 FROM txn"""),
    "display_texts": _plain("""
        SELECT 'transaction' AS entity, 'Transaction ' || id || ' account ' || acct_number || ' merchant '
               || coalesce(merchant_id, 'null') || ' amount ' || amount::varchar AS text FROM txn
        UNION ALL
        SELECT 'merchant', 'Merchant ' || id || ' avgTxn ' || avg_txn_amount::varchar FROM merchant
        UNION ALL
        SELECT 'account', 'Acct ' || acct_number || ' ' || credit_limit::varchar || ' ' || balance::varchar || ' '
               || CASE acct_status WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'OVERDUE' ELSE 'CLOSED' END FROM account"""),
    "routing": _plain("""
        SELECT id AS item_id, 2 + (amount >= 25)::int AS n_applicable, o AS ordinal,
               ['FraudRules:LocationBasedRules', 'FraudRules:Merchant Rules', 'CreditRules:Credit Rules'][o + 1] AS ruleset
        FROM txn, (SELECT unnest([0, 1, 2]) AS o) WHERE o < 2 OR amount >= 25"""),
    "selective_verdicts": _plain("""
        SELECT id, (amount >= 25)::int AS n_applicable,
               CASE WHEN amount < 25 THEN 'Pending' WHEN credit_ok THEN 'Approved' ELSE 'RejectedForCredit' END AS final_status,
               CASE WHEN amount >= 25 AND NOT credit_ok THEN 'CreditRules:Credit Rules' END AS rejecting_ruleset
        FROM scored"""),
    "active_rules": _plain("""
        SELECT id, 'FraudRules:LocationBasedRules|FraudRules:Merchant Rules' AS rules, 2 AS expected_rules FROM txn"""),
    "location_verdicts": _plain("""
        SELECT id, 'FraudRules:LocationBasedRules' AS ruleset, loc_total AS total,
               loc_outcome AS outcome, loc_reason AS reason FROM judged"""),
    "merchant_rule_verdicts": _plain("""
        SELECT id, 'FraudRules:Merchant Rules' AS ruleset, m_risk AS risk, m_outcome AS outcome,
               m_reason AS reason FROM judged"""),
    "risk_rollup": _plain("""
        , rolled AS (
          SELECT id, CASE WHEN amount_risk = 'HIGH' OR rep_risk = 'HIGH' THEN 'HIGH'
                          WHEN amount_risk = 'MEDIUM' AND rep_risk = 'MEDIUM' THEN 'HIGH'
                          WHEN amount_risk = 'MEDIUM' OR rep_risk = 'MEDIUM' THEN 'MEDIUM'
                          ELSE 'LOW' END AS risk FROM scored)
        SELECT id, 'FraudRules:Merchant Rules' AS ruleset, risk,
               CASE risk WHEN 'HIGH' THEN 'RejectedForFraud' ELSE 'Approved' END AS outcome,
               CASE risk WHEN 'HIGH' THEN 'Rated as high risk by merchant rules' ELSE 'No explanation' END AS reason
        FROM rolled"""),
    "ruleset_results": _plain("""
        SELECT id, 'FraudRules:LocationBasedRules' AS ruleset, loc_total AS result_double,
               NULL::varchar AS result_risk, loc_outcome AS outcome, loc_reason AS reason FROM judged
        UNION ALL
        SELECT id, 'FraudRules:Merchant Rules', NULL, m_risk, m_outcome, m_reason FROM judged"""),
    "rule_results": _plain("""
        SELECT id AS item_id, 'FraudRules:LocationBasedRules' AS ruleset,
               'FraudRules:LocationBasedRulesRandomDoubleRule' || p::varchar AS rule,
               round(p + g * p / 5, 6)::double AS result_double, NULL::varchar AS result_risk
        FROM scored, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::double[]) AS p)
        UNION ALL
        SELECT id, 'FraudRules:Merchant Rules', 'FraudRules:Merchant RulesTxnAmtWithinMerchantAvgRange',
               NULL, amount_risk FROM scored"""),
    "evaluation_times": _plain("""
        SELECT 'FraudRules:LocationBasedRules' AS ruleset, count(*) AS n_results, 0::bigint AS evaluation_ms FROM events
        UNION ALL
        SELECT 'FraudRules:Merchant Rules',
               count(*) FILTER (event_type <> 'error') + count(*) FILTER (event_type = 'signup'),
               (count(*) FILTER (event_type <> 'error') * 2 + count(*) FILTER (event_type = 'signup'))::bigint
        FROM events"""),
    "final_verdicts": _plain("""
        SELECT id, 2 AS n_applicable, final_status,
               CASE WHEN loc_outcome <> 'Approved' THEN 'FraudRules:LocationBasedRules'
                    WHEN m_outcome <> 'Approved' THEN 'FraudRules:Merchant Rules' END AS rejecting_ruleset,
               CASE WHEN loc_outcome <> 'Approved' THEN loc_reason
                    WHEN m_outcome <> 'Approved' THEN m_reason END AS rejecting_reason,
               (loc_outcome <> 'Approved')::int + (m_outcome <> 'Approved')::int AS n_rejecting FROM judged"""),
    "assembled_results": _plain("""
        , newest AS (
          SELECT * FROM posted QUALIFY row_number() OVER (PARTITION BY item_id, ruleset ORDER BY posted_ms DESC) = 1)
        SELECT item_id, 2 AS n_applicable, count(*)::int AS n_posted,
               string_agg(ruleset || '=' || outcome, '|' ORDER BY ruleset) AS results FROM newest GROUP BY item_id"""),
    "assembled_whole_results": _plain("""
        SELECT id AS item_id, (CASE WHEN event_type = 'error' THEN 1 ELSE 2 END)::int AS n_posted, 'FraudRules:LocationBasedRules' AS ruleset,
               loc_outcome AS outcome, loc_reason AS reason, loc_total AS result_double, NULL::varchar AS result_risk FROM judged
        UNION ALL
        SELECT id, 2, 'FraudRules:Merchant Rules', m_outcome, m_reason, NULL, m_risk FROM judged WHERE event_type <> 'error'"""),
    "complete_items": _plain(
        "SELECT id AS item_id, 2 AS n_posted FROM txn WHERE event_type <> 'error'"),
    "pending_items": _plain("""
        SELECT id, acct_number, merchant_id, amount FROM txn
        WHERE (SELECT count(DISTINCT ruleset) FROM posted p WHERE p.item_id = txn.id) < 2"""),
    "outcome_counts": _plain("""
        , c AS (SELECT count(*) AS completions, count(*) FILTER (final_status = 'Approved') AS approved,
               sum((loc_outcome <> 'Approved')::int + (m_outcome <> 'Approved')::int)::bigint AS rejected_fraud_events,
               0::bigint AS rejected_credit_events,
               count(*) FILTER (final_status <> 'Approved') AS rejected_txns FROM judged)
        SELECT *, round(rejected_fraud_events / completions, 6)::double AS fraud_rate FROM c"""),
    "rejects_by_ruleset": _plain("""
        SELECT ruleset, count(*) AS n_rejects FROM (
          SELECT 'FraudRules:LocationBasedRules' AS ruleset FROM judged WHERE loc_outcome <> 'Approved'
          UNION ALL SELECT 'FraudRules:Merchant Rules' FROM judged WHERE m_outcome <> 'Approved')
        GROUP BY ruleset"""),
    "outcome_history": _plain(
        "SELECT id, acct_number, merchant_id, amount, final_status FROM judged"),
    "result_lists": _plain("""
        , folded AS (SELECT item_id, ruleset, outcome, count(*) AS c FROM posted GROUP BY ALL)
        SELECT item_id, sum(c)::bigint AS n_results,
               string_agg(ruleset || '=' || outcome || 'x' || c, '|' ORDER BY ruleset || '=' || outcome || 'x' || c) AS results
        FROM folded GROUP BY item_id"""),
    "flattened_results": _plain(
        "SELECT item_id, ruleset, outcome, count(*) AS copies FROM posted GROUP BY ALL"),
    "deducted_results": _plain("""
        SELECT id, loc_outcome || '|' || m_outcome AS combined,
               concat_ws('|', nullif(loc_outcome, 'Approved'), nullif(m_outcome, 'Approved')) AS left_over FROM judged"""),
    "all_true": _plain(
        "SELECT acct_number, coalesce(bool_and(credit_ok), true) AS all_true FROM scored GROUP BY 1"),
    "any_true": _plain(
        "SELECT acct_number, coalesce(bool_or(credit_ok), false) AS any_true FROM scored GROUP BY 1"),
    "running_all_true": _plain("""
        SELECT acct_number, id AS item_id, credit_ok AS passed,
               bool_and(credit_ok) OVER (PARTITION BY acct_number ORDER BY id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_true_so_far
        FROM scored"""),
    "running_all_true_of_account": _plain("""
        SELECT acct_number, id AS item_id, credit_ok AS passed,
               bool_and(credit_ok) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS all_true_so_far
        FROM scored WHERE acct_number = '0000000042'"""),
    "first_results": _plain("""
        SELECT acct_number, arg_min(credit_ok, id) AS first_result, count(*) AS n_received FROM scored GROUP BY 1"""),
    "distinct_rejecting_sets": _plain("""
        SELECT acct_number, concat_ws('|',
                 CASE WHEN bool_or(loc_outcome <> 'Approved') THEN 'FraudRules:LocationBasedRules' END,
                 CASE WHEN bool_or(m_outcome <> 'Approved') THEN 'FraudRules:Merchant Rules' END) AS rulesets
        FROM judged GROUP BY 1"""),
    "result_messages": _plain("""
        SELECT id, CASE WHEN amount < 25 THEN 'Not evaluated' WHEN credit_ok THEN 'evaluated to: true'
                        ELSE 'evaluated to: false' END AS message FROM scored"""),
    "fraud_credit_waterfall": _plain("""
        SELECT id, CASE amount_risk WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 5 END AS fraud_result,
               CASE WHEN amount_risk IN ('MEDIUM', 'LOW') THEN credit_ok END AS payment_result,
               CASE WHEN amount_risk IS NULL THEN 'Pending' WHEN amount_risk = 'HIGH' THEN 'RejectedForFraud'
                    WHEN credit_ok THEN 'Approved' ELSE 'RejectedForCredit' END AS final_status,
               CASE WHEN amount_risk IS NULL THEN 'Merchant must be set' END AS error
        FROM scored"""),
    "credit_limit_lists": _plain("""
        , said AS (
          SELECT id, 'CreditLimitRule' AS rule, credit_ok AS ok FROM scored
          UNION ALL SELECT id, 'CreditReserveRule', balance + amount <= 0.9 * credit_limit FROM scored WHERE amount >= 25
          UNION ALL SELECT id, 'LimitShareRule', amount <= 0.01 * credit_limit FROM scored WHERE n % 2 = 0)
        SELECT id, 3 AS expected_rules, count(*) AS n_results,
               string_agg(rule || ' evaluated to: ' || CASE WHEN ok THEN 'true' ELSE 'false' END, '|' ORDER BY rule) AS results
        FROM said GROUP BY id"""),
    "odd_even_split": _plain("""
        SELECT id, CASE WHEN n % 2 = 0 THEN 'waterfall' ELSE 'credit' END AS flow,
               CASE WHEN n % 2 = 0 AND amount_risk IS NULL THEN 'Pending'
                    WHEN n % 2 = 0 AND amount_risk = 'HIGH' THEN 'RejectedForFraud'
                    WHEN credit_ok THEN 'Approved' ELSE 'RejectedForCredit' END AS final_status
        FROM scored"""),
    "result_monitor": _plain("""
        SELECT id AS item_id, (CASE WHEN event_type = 'error' THEN 1 ELSE 2 END)::int AS n_received, 2 AS n_expected,
               CASE WHEN event_type = 'error' THEN 'INTERMEDIATE' WHEN loc_outcome = 'Approved' THEN 'Approved'
                    ELSE 'RejectedForCredit' END AS status FROM judged"""),
    "merchant_groups": _plain("""
        SELECT count(*) FILTER (try_cast(merchant_id AS int) BETWEEN 1 AND 9) AS n_amazon,
               count(*) FILTER (try_cast(merchant_id AS int) BETWEEN 10 AND 20) AS n_walmart FROM txn"""),
    "stage_latency": _plain("""
        SELECT id, t_routed, n % 20 AS to_executor_ms, n % 35 AS to_aggregator_ms, latency_ms,
               false AS clock_error FROM judged"""),
    "latency_summary": _plain("""
        SELECT sum(latency_ms)::bigint AS total_latency_ms, count(*) AS latency_items,
               round(sum(latency_ms) / count(*), 6)::double AS avg_latency_ms,
               (sum(latency_ms) // count(*))::bigint AS whole_avg_latency_ms FROM judged"""),
    "ruleset_throughput": _plain("""
        , c AS (SELECT ruleset, count(*) AS n_items, max(posted_ms) - min(posted_ms) AS elapsed_ms FROM posted GROUP BY 1)
        SELECT *, printf('%02d:%02d:%02d.%03d', elapsed_ms // 3600000 % 24, elapsed_ms // 60000 % 60,
                         elapsed_ms // 1000 % 60, elapsed_ms % 1000) AS elapsed,
               n_items // (elapsed_ms // 1000) AS tps FROM c"""),
    "run_summary": _plain("""
        , c AS (SELECT max(t_aggregator) - min(t_routed) AS ms, count(*) AS done, sum(latency_ms)::bigint AS lat FROM judged)
        SELECT printf('%02d:%02d:%02d.%03d', ms // 3600000 % 24, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS elapsed,
               (ms + 500) // 1000 AS elapsed_s, done AS completions, done // ((ms + 500) // 1000) AS tps,
               lat // done AS avg_latency_ms FROM c"""),
    "backlog_gauge": """
        SELECT count(*) AS loaded, count(*) FILTER (event_type <> 'error') AS completed,
               count(*) FILTER (event_type = 'error') AS backlog FROM events""",
    "metric_snapshot": _over(_TICKS, query=f"""
        SELECT name, value, (SELECT max(ts_s) FROM txn) AS epoch_s FROM metric {_LAST_READING}"""),
    "metric_lines": _over(_TICKS, query=_LINES),
    "metric_series": _over(_TICKS, query="SELECT tick_s, name, value FROM metric"),
    "verdicts_by_rules_version": _plain("""
        SELECT id, (CASE WHEN later THEN 1 ELSE 0 END)::int AS rules_version, (CASE WHEN later THEN 1 ELSE 2 END)::int AS n_applicable,
               CASE WHEN later THEN m_outcome ELSE final_status END AS final_status,
               CASE WHEN NOT later AND loc_outcome <> 'Approved' THEN 'FraudRules:LocationBasedRules'
                    WHEN m_outcome <> 'Approved' THEN 'FraudRules:Merchant Rules' END AS rejecting_ruleset
        FROM (SELECT *, ts >= TIMESTAMP '2024-01-01 12:00:00' AS later FROM judged)"""),
    "payment_rate": _over(_TICKS, query="""
        SELECT ((tick + 1) * 5)::bigint AS tick_s, done::bigint AS completions,
               (done - lag(done, 1, 0) OVER (ORDER BY tick)) / 5.0::double AS payments_per_s FROM cumulative"""),
    "dashboard_status": _over(_TICKS, query=f"""
        SELECT name, value, tick_s AS at_s,
               CASE name WHEN 'bib.payment.rate' THEN CASE WHEN value < 500 THEN 'red' WHEN value < 1000 THEN 'amber' ELSE 'green' END
                         WHEN 'bib.fraud.rate' THEN CASE WHEN value < 0.2 THEN 'green' WHEN value < 0.5 THEN 'amber' ELSE 'red' END
                         ELSE CASE WHEN value < 20 THEN 'green' WHEN value < 50 THEN 'light green' ELSE 'red' END END AS colour
        FROM metric {_LAST_READING} AND name IN ('bib.payment.rate', 'bib.fraud.rate', 'bib.latency.avg')"""),
    "dashboard_panel": _over(_TICKS, query="""
        SELECT tick_s, name, value FROM metric WHERE tick_s > (SELECT max(tick_s) FROM metric) - 300"""),
    "ruleset_counters": _plain("""
        SELECT 'FraudRules:LocationBasedRules' AS name, 'bib.rejectedby.FraudRules_LocationBasedRules' AS metric,
               count(*) AS value FROM judged WHERE loc_outcome <> 'Approved'
        UNION ALL
        SELECT 'FraudRules:Merchant Rules', 'bib.rejectedby.FraudRules_Merchant_Rules', count(*)
        FROM judged WHERE m_outcome <> 'Approved'"""),
    "sliding_merchant_avg": _over(_WINDOWS, query="SELECT merchant_id, window_end_s, round(avg_amount, 6) AS avg_amount, n_txns FROM windowed"),
    "sliding_merchant_spread": _plain("""
        SELECT merchant_id, (ts_s // 5 + k) * 5 AS window_end_s, count(*) AS n, round(stddev_pop(amount), 4) AS spread,
               round(avg((amount >= 25)::int), 6) AS large_share
        FROM txn, (SELECT unnest(generate_series(1, 20)) AS k) WHERE merchant_id IS NOT NULL GROUP BY ALL"""),
    "spread_without_clicks": _plain("""
        SELECT acct_number, count(*) AS n, round(sum(amount), 4) AS total, round(stddev_pop(amount), 4) AS spread
        FROM txn WHERE event_type <> 'click' GROUP BY 1"""),
    "tumbling_tps": _plain("""
        SELECT (ts_s // 30 + 1) * 30 AS window_end_s, count(*) AS n_items,
               (count(*) // 30)::varchar || ' TPS' AS tps FROM txn GROUP BY ts_s // 30"""),
    "updated_merchants": _over(_WINDOWS, query="""
        SELECT m.id, m.name, m.reputation, round(w.avg_amount, 6) AS avg_txn_amount, m.location, w.window_end_s
        FROM merchant m JOIN (
          SELECT * FROM windowed WHERE window_end_s <= (SELECT max(ts_s) FROM txn)
          QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY window_end_s DESC) = 1) w
        ON m.id = w.merchant_id"""),
    "average_changes": _over(_WINDOWS, query="""
        SELECT merchant_id, window_end_s, round(old_average, 6) AS old_average, round(new_average, 6) AS new_average FROM (
          SELECT w.merchant_id, w.window_end_s, w.avg_amount AS new_average,
                 coalesce(lag(w.avg_amount) OVER (PARTITION BY w.merchant_id ORDER BY w.window_end_s),
                          m.avg_txn_amount) AS old_average
          FROM windowed w JOIN merchant m ON w.merchant_id = m.id)
        WHERE round(abs(new_average - old_average), 9) > 1.0"""),
    "asof_feedback": _over(_WINDOWS, query="""
        , live AS (
          SELECT s.*, coalesce(w.avg_amount, s.avg_txn_amount) AS average
          FROM scored s ASOF LEFT JOIN windowed w
            ON s.merchant_id = w.merchant_id AND s.ts_s >= w.window_end_s)
        SELECT id, CASE WHEN m_id IS NOT NULL THEN round(average, 6) END AS average,
               CASE WHEN m_id IS NULL THEN 'LOW'
                    WHEN amount BETWEEN average - trunc(average / 5) AND average + trunc(average / 5) THEN 'LOW'
                    WHEN amount BETWEEN average - 2 * trunc(average / 5) AND average + 2 * trunc(average / 5) THEN 'MEDIUM'
                    ELSE 'HIGH' END AS risk FROM live"""),
    "newest_per_account": _plain("""
        SELECT acct_number, id, merchant_id, amount, ts_ms FROM txn
        QUALIFY row_number() OVER (PARTITION BY acct_number ORDER BY ts DESC, id DESC) = 1"""),
    "idle_retention": _plain("""
        SELECT id, final_status FROM judged
        WHERE ts >= (SELECT max(ts) FROM txn) - INTERVAL 300 SECOND"""),
    "newest_outcomes": _plain("""
        SELECT id, final_status FROM judged WHERE final_status = 'RejectedForFraud'
        ORDER BY ts DESC, id DESC LIMIT 10000"""),
    "newest_approvals": _plain("""
        SELECT id, final_status FROM judged WHERE final_status = 'Approved'
        ORDER BY ts DESC, id DESC LIMIT 100"""),
    "quarantined": _plain("""
        SELECT id, merchant_id, CASE WHEN merchant_id IS NULL THEN 'malformed merchant id'
                                     ELSE 'unknown merchant' END AS error FROM scored WHERE m_id IS NULL"""),
    "error_log": _plain("""
        SELECT event_type AS component,
               arg_max(CASE WHEN merchant_id IS NULL THEN 'malformed merchant id' ELSE 'unknown merchant' END, ts) AS error,
               count(*) AS n_errors FROM scored WHERE m_id IS NULL GROUP BY 1"""),
}

# A stream over a stored table must end with the batch answer.
SQL |= {
    "stream_verdicts": SQL["final_verdicts"],
    "stream_throughput": SQL["tumbling_tps"],
    "stream_merchant_avg": SQL["sliding_merchant_avg"],
    "stream_updated_merchants": SQL["updated_merchants"],
    # A signup is complete with its early approval; items that lack a result time out after 300 seconds.
    "stream_assembly": _plain("""
        , firsts AS (SELECT item_id, ruleset, min(posted_ms) AS f FROM posted GROUP BY ALL),
        ended AS (SELECT item_id, CASE WHEN count(*) >= 2 THEN max(f) END AS ended_at FROM firsts GROUP BY 1),
        counted AS (
          SELECT item_id, ruleset, arg_max(outcome, posted_ms) AS outcome, any_value(ended_at) AS ended_at
          FROM posted JOIN ended USING (item_id) WHERE ended_at IS NULL OR posted_ms <= ended_at GROUP BY ALL)
        SELECT item_id, CASE WHEN ended_at IS NULL THEN 'TIMED_OUT' ELSE 'COMPLETE' END AS status, count(*)::int AS n_posted,
               string_agg(ruleset || '=' || outcome, '|' ORDER BY ruleset) AS results
        FROM counted JOIN txn ON txn.id = item_id
        WHERE ended_at IS NOT NULL OR ts + INTERVAL 300 SECOND < (SELECT max(ts) FROM txn) GROUP BY item_id, ended_at"""),
    "stream_feedback": SQL["asof_feedback"],
    "stream_envelopes": _plain("SELECT id AS item_id, 2 AS n_applicable, t_routed, amount FROM judged"),
    "stream_metrics": SQL["metric_snapshot"],
    "stream_metric_series": SQL["metric_series"],
    "stream_credit_lists": SQL["credit_limit_lists"],
    "stream_stage_report": """
        SELECT stage, (SELECT count(*) FROM events) AS n_items, true AS in_order, CASE WHEN stage = 'Aggregator' THEN true END AS has_latency
        FROM (SELECT unnest(['FraudRules:LocationBasedRules', 'FraudRules:Merchant Rules', 'Aggregator']) AS stage)""",
    "stream_pending_items": _plain("""
        SELECT item_id, 2 AS n_applicable, count(*) AS n_results, string_agg(ruleset || '=' || outcome, '|' ORDER BY ruleset, outcome) AS results
        FROM posted GROUP BY item_id HAVING count(DISTINCT ruleset) < 2"""),
}
