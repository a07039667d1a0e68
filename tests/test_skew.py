"""A key holding a third of the rows: results stay exact and AQE splits it."""

import contextlib
import io

import pandas as pd
import pytest

from frames import ticket_frame, txn_frame
from ledgerlens.plans import analyses as A
from ledgerlens.plans import dashboard as D

N = 3000


@pytest.fixture()
def skew_conf(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _frames(spark):
    txn = txn_frame(spark, [{"status": "Failed", "failure_reason": f"R{i % 5}",
                             "gateway": "GatewayC" if i < N // 3 else f"Gateway{'ABD'[i % 3]}"}
                            for i in range(N)])
    # A third of all tickets point at one transaction.
    tk = ticket_frame(spark, [{"related_transaction_id": "TXN100007" if i < N // 3 else f"TXN{100000 + i}",
                               "csat_score": 1 + i % 5, "resolution_time_hours": round(0.25 * (i % 40), 2)}
                              for i in range(N)])
    return txn, tk


def test_hot_join_key_is_split_and_exact(spark, skew_conf):
    txn, tk = _frames(spark)
    df = A.ticket_impact_by_reason(tk, txn)
    got = {r["failure_reason"]: (r["tickets_generated"], r["avg_csat"]) for r in df.collect()}
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "skew=true" in buf.getvalue()

    t, k = txn.toPandas(), tk.toPandas()
    m = k.merge(t, left_on="related_transaction_id", right_on="transaction_id")
    want = {}
    for reason, g in m.groupby("failure_reason"):
        mean = g["csat_score"].sum() / len(g)
        want[reason] = (g["ticket_id"].nunique(), float(int(mean * 100 + 0.5 + 1e-9)) / 100)
    assert got == want


def test_hot_group_key_uses_partial_aggregation(spark, skew_conf):
    txn, _ = _frames(spark)
    df = D.gateway_performance(txn)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "partial_count" in buf.getvalue()
    got = {r["gateway"]: r["total"] for r in df.collect()}
    want = txn.toPandas().groupby("gateway")["transaction_id"].count().to_dict()
    assert got == want and got["GatewayC"] == N // 3
