"""Derivation rules on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from frames import ticket_frame, txn_frame
from ledgerlens.operators import enrich as EN


def test_risk_score_bumps_and_clip(spark):
    df = spark.createDataFrame(
        [(50.0, 100000.0, 30), (50.0, 100000.01, 29), (95.0, 200000.0, 1), (-5.0, 10.0, 400), (10.04, 1.0, 400),
         (10.05, 1.0, 400)],
        "base double, amount double, age int")
    got = [r[0] for r in df.select(EN.risk_score("base", "amount", "age")).collect()]
    # No bump at exactly 100000 / 30 days; both bumps just past; clipped to 100 and 0;
    # one decimal, rounded as numpy rounds (half to even on x * 10).
    import numpy as np
    assert got == [50.0, 77.0, 100.0, 0.0, float(np.round(10.04, 1)), float(np.round(10.05, 1))]


def test_resolution_time_penalties_and_rounding(spark):
    df = spark.createDataFrame(
        [(1.0, "Fraud-Risk", 4), (1.0, "Tier2-Technical", 12), (1.0, "Billing-Ops", 48), (0.125, "Premium-Care", 0)],
        "base double, team string, target int")
    got = [r[0] for r in df.select(EN.resolution_time("base", "team", "target")).collect()]
    assert got == [11.6, 7.8, 8.2, 0.12]


def test_sla_enrichment_is_strict(spark):
    df = ticket_frame(spark, [{"priority": "Critical", "resolution_time_hours": 4.0},
                              {"priority": "Critical", "resolution_time_hours": 4.01},
                              {"priority": "Low", "resolution_time_hours": 48.0},
                              {"priority": "Medium", "resolution_time_hours": 30.0}])
    got = [(r["sla_target_hours"], r["sla_breached"]) for r in EN.enrich_sla(df).collect()]
    assert got == [(4, 0), (4, 1), (48, 0), (24, 1)]


def test_resolved_at_only_for_closed_tickets(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    df = ticket_frame(spark, [{"created_at": t0, "resolution_time_hours": 1.5, "status": s}
                              for s in ["Resolved", "Closed", "Reopened", "Pending"]])
    got = [r["resolved_at"] for r in EN.enrich_resolved_at(df).collect()]
    assert got == [t0 + dt.timedelta(hours=1.5)] * 3 + [None]


def test_failure_expectation_bands(spark):
    df = txn_frame(spark, [{"gateway": "GatewayC", "timestamp": dt.datetime(2024, 1, 1, 1, 0), "status": "Failed"},
                           {"gateway": "GatewayC", "timestamp": dt.datetime(2024, 1, 1, 4, 59)},
                           {"gateway": "GatewayC", "timestamp": dt.datetime(2024, 1, 1, 5, 0)},
                           {"gateway": "GatewayA", "timestamp": dt.datetime(2024, 1, 1, 0, 59)}])
    got = {(r["gateway"], r["night"]): (r["txns"], r["expected_rate_pct"], r["observed_rate_pct"])
           for r in EN.failure_expectation(df).collect()}
    assert got == {("GatewayC", True): (2, 24.0, 50.0), ("GatewayC", False): (1, 18.0, 0.0),
                   ("GatewayA", False): (1, 7.0, 0.0)}


def test_ticket_links_cover_every_ticket_once(spark):
    df = ticket_frame(spark, [{"related_transaction_id": v} for v in ["TXN100001", "", None, "TXN100002"]])
    got = sorted((r["ticket_id"], r["link_kind"]) for r in EN.ticket_links(df).collect())
    assert got == [("TCK200000", "linked"), ("TCK200001", "unlinked"), ("TCK200002", "unlinked"),
                   ("TCK200003", "linked")]


def test_link_candidates_size_rule(spark):
    txn = txn_frame(spark, [{"status": "Failed" if i % 2 else "Success"} for i in range(200)])
    assert EN.link_candidates(txn, n_tickets=100).count() == 60        # 0.6 * 100 < 100 failed
    assert EN.link_candidates(txn, n_tickets=1000).count() == 100      # all failed
    assert EN.link_candidates(txn, n_tickets=100).where(F.col("status") != "Failed").count() == 0
