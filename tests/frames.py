"""Hand-made frames with the fixed schemas (defaults for unspecified columns)."""

import datetime as dt

from ledgerlens.sources.schemas import SUPPORT_TICKETS, TRANSACTIONS

TXN_DEFAULTS = dict(
    transaction_id=None, timestamp=dt.datetime(2024, 1, 1, 12, 0), customer_id=1, channel="UPI",
    transaction_type="Refund", amount=100.0, currency="INR", status="Success", failure_reason=None,
    processing_time_ms=300, gateway="GatewayA", region="North", device_type="Web", retry_count=0,
    is_fraud_flag=0, merchant_category="Fuel", account_age_days=400, risk_score=10.0)

TICKET_DEFAULTS = dict(
    ticket_id=None, created_at=dt.datetime(2024, 1, 1, 12, 0), resolved_at=None, customer_id=1,
    related_transaction_id=None, issue_category="KYC Issue", priority="Low", channel="Email",
    region="North", sla_target_hours=48, resolution_time_hours=10.0, sla_breached=0,
    agent_id="AGT1000", agent_team="Tier1-Support", csat_score=4, status="Resolved",
    escalation_flag=0, reopened_count=0)


def txn_frame(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = dict(TXN_DEFAULTS, transaction_id=f"TXN{100000 + i}")
        d.update(r)
        out.append(tuple(d[f.name] for f in TRANSACTIONS))
    return spark.createDataFrame(out, TRANSACTIONS)


def ticket_frame(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = dict(TICKET_DEFAULTS, ticket_id=f"TCK{200000 + i}")
        d.update(r)
        out.append(tuple(d[f.name] for f in SUPPORT_TICKETS))
    return spark.createDataFrame(out, SUPPORT_TICKETS)
