"""Names, texts, limits and lists that results must carry exactly.

Nothing here is computed; every entry is part of the published behaviour.
"""

# Cities that count as close to one another, group by group.
CITY_GROUPS = (
    ("Atlanta", "Memphis", "Orlando", "Nashville"),
    ("London", "Edinburgh", "Dublin", "Paris"),
    ("Istanbul", "Athens", "Sofia", "Ankara"),
    ("San Francisco", "Las Vegas", "Los Angeles", "Seattle"),
)

ACCOUNT_STATUSES = ("CURRENT", "OVERDUE", "CLOSED")
RISK_SCORES = {"HIGH": 90, "MEDIUM": 50, "LOW": 5}
FRAUD_SCORE_CUTOFF = 60

FRAUD_RULES = "FraudRules"
CREDIT_RULES = "CreditRules"

APPROVED = "Approved"
REJECTED_FOR_FRAUD = "RejectedForFraud"
REJECTED_FOR_CREDIT = "RejectedForCredit"
OUTCOMES = (APPROVED, REJECTED_FOR_FRAUD, REJECTED_FOR_CREDIT)
PENDING = "Pending"

LOCATION_RULESET = "LocationBasedRules"
MERCHANT_RULESET = "Merchant Rules"
AMOUNT_RULE = "TxnAmtWithinMerchantAvgRange"
CREDIT_LIMIT_RULE = "CreditLimitRule"
DOUBLE_RULE_PREFIX = "RandomDoubleRule"
BOOLEAN_RULE_PREFIX = "RandomBoolean"
LOCATION_RULE_MEANS = (0.1, 0.2, 0.3, 0.4, 0.5)
LOCATION_REJECT_AT_OR_BELOW = 1.0

NO_REASON = "No explanation"
LOCATION_REASON = "Sum of results exceeds threshold"
MERCHANT_REASON = "Rated as high risk by merchant rules"
NOT_EVALUATED = "Not evaluated"
EVALUATED_PREFIX = "evaluated to: "

MERCHANT_ID_DIGITS = 8
ACCOUNT_ID_DIGITS = 10
TRANSACTION_ID_DIGITS = 14

# Merchant number ranges that feed the two named payment counters.
MERCHANT_GROUPS = {"amazon": (1, 9), "walmart": (10, 20)}

# Names of the metrics; a rule set's reject counter has its own name behind the prefix.
FRAUD_RATE = "bib.fraud.rate"
PAYMENT_RATE = "bib.payment.rate"
ALL_PAYMENTS = "bib.payments.all"
MEAN_LATENCY = "bib.latency.avg"
GROUP_PAYMENTS = {"amazon": "bib.payments.amazon", "walmart": "bib.payments.walmart"}
REJECTS_PREFIX = "bib.rejectedby."
INTERNAL_COUNTER_PREFIX = "pnCounter"
INTERNAL_COUNTERS = {
    "pnCounterApproved": "approved",
    "pnCounterRejectedForFraud": "rejected_fraud_events",
    "pnCounterRejectedForCredit": "rejected_credit_events",
}
METRIC_INTERVAL_S = 5

AVERAGE_WINDOW_S = 100
AVERAGE_SLIDE_S = 5
THROUGHPUT_WINDOW_S = 30
SIGNIFICANT_CHANGE = 1.0

# The idle limit of kept rows.
IDLE_LIMIT_S = 300

# Dashboard bands: metric -> (lower bound, upper bound, colour below, between, above).
DASHBOARD_BANDS = {
    PAYMENT_RATE: (500.0, 1000.0, "red", "amber", "green"),
    FRAUD_RATE: (0.2, 0.5, "green", "amber", "red"),
    MEAN_LATENCY: (20.0, 50.0, "green", "light green", "red"),
}
DASHBOARD_SPAN_S = 300
