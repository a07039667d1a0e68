"""Fixed schemas of the two operational tables.

Declared up front so that CSV reads never infer types (an extra pass, and
types that drift between files), and so that Parquet and CSV give the same
columns in the same order.
"""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("transaction_type", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("failure_reason", T.StringType(), True),
    T.StructField("processing_time_ms", T.IntegerType(), True),
    T.StructField("gateway", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("device_type", T.StringType(), True),
    T.StructField("retry_count", T.IntegerType(), True),
    T.StructField("is_fraud_flag", T.IntegerType(), True),
    T.StructField("merchant_category", T.StringType(), True),
    T.StructField("account_age_days", T.IntegerType(), True),
    T.StructField("risk_score", T.DoubleType(), True),
])

SUPPORT_TICKETS = T.StructType([
    T.StructField("ticket_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("resolved_at", T.TimestampNTZType(), True),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("related_transaction_id", T.StringType(), True),
    T.StructField("issue_category", T.StringType(), True),
    T.StructField("priority", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("sla_target_hours", T.IntegerType(), True),
    T.StructField("resolution_time_hours", T.DoubleType(), True),
    T.StructField("sla_breached", T.IntegerType(), True),
    T.StructField("agent_id", T.StringType(), True),
    T.StructField("agent_team", T.StringType(), True),
    T.StructField("csat_score", T.IntegerType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("escalation_flag", T.IntegerType(), True),
    T.StructField("reopened_count", T.IntegerType(), True),
])

TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS.fields]
TICKET_COLUMNS = [f.name for f in SUPPORT_TICKETS.fields]

# Timestamp columns of each table, the ones the source parses as dates.
TIMESTAMP_COLUMNS = {
    "transactions": ["timestamp"],
    "support_tickets": ["created_at", "resolved_at"],
}
