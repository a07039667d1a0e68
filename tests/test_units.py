"""Edge cases on hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from frames import ticket_frame, txn_frame
from ledgerlens.functions import core as fx
from ledgerlens.operators import anomaly, stats
from ledgerlens.operators.filters import ViewFilter, filter_tickets, filter_transactions
from ledgerlens.plans import analyses as A
from ledgerlens.plans import dashboard as D


def _flags(df, col, k=3.0):
    return [r[0] for r in df.select(stats.zscore_flags(df, col, k)).collect()]


def test_zscore_constant_column_is_all_false(spark):
    df = txn_frame(spark, [{"processing_time_ms": 500}] * 10)
    assert _flags(df, "processing_time_ms") == [False] * 10


def test_zscore_one_row_and_all_null(spark):
    assert _flags(txn_frame(spark, [{}]), "processing_time_ms") == [False]
    df = txn_frame(spark, [{"processing_time_ms": None}] * 3)
    assert _flags(df, "processing_time_ms") == [False] * 3


def test_zscore_one_extreme_among_twenty(spark):
    rows = [{"processing_time_ms": 100 + (i % 3)} for i in range(19)] + [{"processing_time_ms": 100000}]
    df = txn_frame(spark, rows)
    assert _flags(df, "processing_time_ms") == [False] * 19 + [True]


def test_population_z_matches_formula(spark):
    vals = [50, 60, 70, 80, 5000]
    df = txn_frame(spark, [{"processing_time_ms": v} for v in vals])
    rows, z = stats.with_population_z(df, "processing_time_ms")
    got = [r[0] for r in rows.select(z.z).collect()]
    n = len(vals); m = sum(vals) / n; sd = (sum((v - m) ** 2 for v in vals) / n) ** 0.5
    for g, v in zip(got, vals):
        assert abs(g - (v - m) / sd) < 1e-12


def test_reason_tags(spark):
    base = [{"processing_time_ms": 300, "amount": 100.0}] * 40
    rows = base + [
        {"retry_count": 3},                                 # High retries (2 would not)
        {"retry_count": 2},
        {"risk_score": 75.0},                               # not > 75
        {"risk_score": 75.5},
        {"status": "Failed"},
        {"processing_time_ms": 90000, "amount": 1e7, "retry_count": 5, "risk_score": 99.0, "status": "Failed"},
    ]
    df = txn_frame(spark, rows)
    got = [r[0] for r in anomaly.with_reasons(df).select("anomaly_reason").collect()]
    assert got[:40] == ["Multivariate pattern"] * 40
    assert got[40:] == [
        "High retries", "Multivariate pattern", "Multivariate pattern", "High risk score", "Failed txn",
        "Slow processing, Unusual amount, High retries, High risk score, Failed txn"]


def test_sla_risk_boundaries(spark):
    as_of = dt.datetime(2024, 2, 1, 0, 0, 0)
    target = 10
    def at(hours, secs=0):
        return as_of - dt.timedelta(hours=hours, seconds=secs)
    rows = [
        {"created_at": at(8), "sla_target_hours": target, "status": "Pending"},          # exactly 0.8·target
        {"created_at": at(8, 1), "sla_target_hours": target, "status": "Pending"},       # just past
        {"created_at": at(10), "sla_target_hours": target, "status": "Pending"},         # exactly target
        {"created_at": at(10, 1), "sla_target_hours": target, "status": "Pending"},      # just past
        {"created_at": as_of + dt.timedelta(hours=3), "sla_target_hours": target, "status": "Pending"},
        {"created_at": at(50), "sla_target_hours": target, "status": "Resolved"},        # not open
    ]
    df = ticket_frame(spark, rows)
    out = {r["ticket_id"]: (r["sla_risk_status"], r["hours_open"])
           for r in A.sla_risk(df, as_of=as_of).collect()}
    assert out["TCK200000"] == ("ON TRACK", 8.0)
    assert out["TCK200001"][0] == "AT RISK"
    assert out["TCK200002"] == ("AT RISK", 10.0)
    assert out["TCK200003"][0] == "BREACHED"
    assert out["TCK200004"] == ("ON TRACK", -3.0)
    assert "TCK200005" not in out


def test_having_19_vs_20(spark):
    rows = [{"agent_id": "AGT1", "resolution_time_hours": 5.0}] * 19 + \
           [{"agent_id": "AGT2", "resolution_time_hours": 7.0}] * 20
    df = ticket_frame(spark, rows)
    got = [(r["agent_id"], r["tickets_handled"]) for r in A.agent_efficiency(df).collect()]
    assert got == [("AGT2", 20)]
    got = [(r["agent_id"], r["tickets"]) for r in D.bottleneck_agents(df).collect()]
    assert got == [("AGT2", 20)]


def test_ticket_join_cases(spark):
    txn = txn_frame(spark, [
        {"status": "Failed", "failure_reason": "Network Error"},   # TXN100000
        {"status": "Reversed", "failure_reason": None},             # TXN100001
    ])
    tk = ticket_frame(spark, [
        {"related_transaction_id": "TXN100000", "csat_score": 2, "resolution_time_hours": 1.25},
        {"related_transaction_id": "TXN100000", "csat_score": 3, "resolution_time_hours": 1.0},
        {"related_transaction_id": "TXN100001", "csat_score": 5},
        {"related_transaction_id": "TXN999999"},
        {"related_transaction_id": ""},
        {"related_transaction_id": None},
    ])
    out = {r["failure_reason"]: (r["tickets_generated"], r["avg_csat"], r["avg_resolution_hours"])
           for r in A.ticket_impact_by_reason(tk, txn).collect()}
    assert out == {"Network Error": (2, 2.5, 1.13), None: (1, 5.0, 10.0)}


def test_filters(spark):
    txn = txn_frame(spark, [
        {"timestamp": dt.datetime(2024, 1, 1, 0, 0)},
        {"timestamp": dt.datetime(2024, 1, 5, 23, 59, 59, 999999), "region": "South"},
        {"timestamp": dt.datetime(2024, 1, 6, 0, 0), "gateway": "GatewayC"},
        {"timestamp": dt.datetime(2024, 1, 10, 12, 0)},
    ])
    tk = ticket_frame(spark, [{"created_at": dt.datetime(2024, 1, 11, 0, 0)},
                              {"created_at": dt.datetime(2024, 1, 10, 23, 59, 59)}])
    assert filter_transactions(txn, ViewFilter(regions=[])).count() == 0
    assert filter_transactions(txn, ViewFilter("2024-01-01", "2024-01-05")).count() == 2
    # An incomplete pair means the full range.
    assert filter_transactions(txn, ViewFilter("2024-01-03", None)).count() == 4
    assert filter_transactions(txn, ViewFilter(gateways=["GatewayA"])).count() == 3
    # Default ticket bounds come from the transactions: the later ticket drops out.
    assert [r["ticket_id"] for r in filter_tickets(tk, txn).collect()] == ["TCK200001"]


def test_kpis_of_empty_view_are_zero(spark):
    txn = txn_frame(spark, [{}]).where(F.lit(False))
    tk = ticket_frame(spark, [{}]).where(F.lit(False))
    r = D.kpi_summary(txn, tk).first().asDict()
    assert r == {"total_txns": 0, "success_rate": 0.0, "failure_rate": 0.0, "avg_proc_time": 0.0,
                 "total_tickets": 0, "sla_breach_rate": 0.0, "avg_resolution": 0.0, "avg_csat": 0.0}


def test_rounding_helpers(spark):
    df = spark.createDataFrame([(1, 8, 0.145, 0.125, -2.5), (2, 3, 1.005, 0.135, 2.5)],
                               "num long, den long, a double, b double, c double")
    got = df.select(fx.rate_pct_2dp("num", "den").alias("r"), fx.round_half_even("b", 2).alias("e"),
                    fx.round_half_away("c", 0).alias("h")).collect()
    assert [g["r"] for g in got] == [12.5, 66.67]
    assert [g["e"] for g in got] == [0.12, 0.14]
    assert [g["h"] for g in got] == [-3.0, 3.0]


def test_failure_reasons_denominator_counts_all_failed(spark):
    df = txn_frame(spark, [{"status": "Failed", "failure_reason": "Network Error"}] * 3
                   + [{"status": "Failed", "failure_reason": ""}])
    r = A.failure_reasons(df).first()
    assert (r["failure_reason"], r["occurrences"], r["pct_of_all_failures"]) == ("Network Error", 3, 75.0)


def test_sla_risk_default_now_is_utc_wall_clock(spark):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    df = ticket_frame(spark, [{"created_at": now - dt.timedelta(hours=5), "status": "Pending",
                               "sla_target_hours": 4}])
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = A.sla_risk(df).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert 4.9 < r["hours_open"] < 5.5 and r["sla_risk_status"] == "BREACHED"


def test_scale_settings():
    from ledgerlens.session import scale_settings
    s = scale_settings(100 * 10**12, 8000)
    assert s["spark.sql.shuffle.partitions"] == "100000"
    assert scale_settings(50 * 2**20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_reason_tags_one_per_row(spark):
    base = [{"processing_time_ms": 300 + (i % 7), "amount": 100.0 + (i % 5)} for i in range(60)]
    rows = base + [{"processing_time_ms": 5000}, {"amount": 90000.0}]
    df = txn_frame(spark, rows)
    got = [r[0] for r in anomaly.with_reasons(df).select("anomaly_reason").collect()]
    assert got[-2:] == ["Slow processing", "Unusual amount"]
    assert set(got[:60]) == {"Multivariate pattern"}


def test_materialize_paths(spark, monkeypatch):
    from ledgerlens import session
    df = spark.range(0, 100).withColumn("x", F.col("id") * 2)
    import contextlib
    import io as _io
    t = session.materialize(df, as_table=True)          # a table in the checkpoint folder
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        t.explain()
    assert t.count() == 100 and "FileScan parquet" in buf.getvalue()
    monkeypatch.setattr(session, "configured_checkpoint_dir", lambda s: None)
    p = session.materialize(df)                          # no folder: persisted
    assert p.is_cached and p.count() == 100
    session.drop_materialized(p)
    session.drop_materialized(t)


def test_means_and_quartiles_do_not_round_their_inputs(spark):
    """Hours with three decimals."""
    df = ticket_frame(spark, [{"resolution_time_hours": v, "agent_id": "AGT1"} for v in (1.001, 1.002, 1.004, 1.008)])
    r = D.resolution_distribution(df).first()
    assert (r["min"], r["median"], r["max"]) == (1.001, 1.003, 1.008)
    assert abs(r["q1"] - 1.00175) < 1e-9 and abs(r["q3"] - 1.005) < 1e-9
    assert abs(D.kpi_summary(txn_frame(spark, [{}]), df).first()["avg_resolution"] - 1.00375) < 1e-12
    assert abs(D.bottleneck_agents(df, min_tickets=1).first()["avg_resolution"] - 1.00375) < 1e-12


def test_z_score_of_a_large_spread_does_not_overflow(spark):
    from pyspark.sql import functions as F
    df = spark.range(1000).select(F.when(F.col("id") == 0, 2_000_000_000).otherwise(F.col("id")).cast("int").alias("x"))
    rows, z = stats.with_population_z(df, "x")
    assert rows.where(z.beyond(3)).count() == 1
