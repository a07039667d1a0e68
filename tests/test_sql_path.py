"""The SQL path: temp views over the two tables, and julianday() in statements."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from frames import ticket_frame, txn_frame
from ledgerlens.plans import sql as S


@pytest.fixture()
def views(spark):
    day = dt.datetime(2024, 3, 1)
    txn = txn_frame(spark, [{"amount": 10.0 * i, "timestamp": day + dt.timedelta(hours=i)} for i in range(6)])
    tk = ticket_frame(spark, [{"created_at": day + dt.timedelta(minutes=90 * i), "csat_score": i} for i in range(4)])
    S.register(spark, txn, tk)
    return txn, tk


def test_views_hold_the_frames(spark, views):
    for name, frame in zip(("transactions", "support_tickets"), views):
        assert spark.table(name).columns == frame.columns
        assert sorted(spark.sql(f"TABLE {name}").collect()) == sorted(frame.collect())


def test_views_are_replaced_by_a_second_registration(spark, views):
    S.register(spark, views[0].limit(2), views[1].limit(1))
    assert spark.sql("SELECT (SELECT count(*) FROM transactions) - (SELECT count(*) FROM support_tickets)").first()[0] == 1


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_julianday_of_an_instant_does_not_depend_on_the_zone(spark, views, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        epoch = spark.sql("SELECT julianday('1970-01-01 12:00:00')").first()[0]
        now = spark.sql("SELECT julianday('now')").first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert abs(epoch - 2440588.0) < 1e-9
    assert abs(now - (time.time() / 86400 + 2440587.5)) < 1e-3


def test_julianday_of_a_column_orders_and_subtracts(spark, views):
    rows = spark.sql("SELECT ticket_id, round((julianday(created_at) - julianday('2024-03-01 00:00:00')) * 1440) AS minutes "
                     "FROM support_tickets ORDER BY minutes DESC").collect()
    assert [r["minutes"] for r in rows] == [270.0, 180.0, 90.0, 0.0]
    assert [r["ticket_id"] for r in rows] == [f"TCK{200000 + i}" for i in (3, 2, 1, 0)]


def test_julianday_runs_without_python(spark, views):
    plan = spark.sql("SELECT max(julianday(timestamp)) FROM transactions")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "timestampdiff" in plan


def test_decimal_literals_keep_the_value(spark, views):
    got = spark.sql("SELECT 7.5 * count(*) / 2 AS x, sum(amount) * 0.5 AS y FROM transactions").first()
    assert float(got["x"]) == 22.5 and got["y"] == views[0].agg(F.sum("amount")).first()[0] / 2
