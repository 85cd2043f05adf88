"""Schemas of the three stored tables and of the rows the operators exchange."""

from pyspark.sql import types as T

ACCOUNT = T.StructType([
    T.StructField("acct_number", T.StringType(), False),
    T.StructField("credit_limit", T.DoubleType()),
    T.StructField("balance", T.DoubleType()),
    T.StructField("acct_status", T.ShortType()),
    T.StructField("location", T.StringType()),
])

MERCHANT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("reputation", T.ShortType()),
    T.StructField("avg_txn_amount", T.DoubleType()),
    T.StructField("location", T.StringType()),
])

TRANSACTION = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("acct_number", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# The given tables these are derived from. Reading with a schema saves a pass
# over the file footers, and a stream needs one anyway.
GIVEN = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}
