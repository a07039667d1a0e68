"""Joins over tables bucketed by the join key; CSV records that do not fit."""

import os

from conftest import SF_SMALL
from frames import ticket_frame, txn_frame

from ledgerlens.plans import analyses, build
from ledgerlens.plans.registry import all_queries
from ledgerlens.sources import io
from ledgerlens.sources.schemas import TRANSACTION_COLUMNS


def test_the_join_has_no_exchange_on_either_side(spark, tmpdir_path):
    txn = txn_frame(spark, [{"transaction_id": f"T{i}", "failure_reason": f"r{i % 3}"} for i in range(50)])
    tickets = ticket_frame(spark, [{"related_transaction_id": f"T{i % 60}"} for i in range(90)] + [
        {"related_transaction_id": ""}, {"related_transaction_id": None}] * 40)
    build.store_links(spark, txn, tickets, "links_test", tmpdir_path, 6)
    stored_txn, stored_tickets = build.load_links(spark, "links_test")
    assert stored_tickets.count() == 90
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = analyses.ticket_impact_by_reason(stored_tickets, stored_txn)
        plan = got._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        assert "Exchange" not in join and "SelectedBucketsCount: 6 out of 6" in join
        assert got.collect() == analyses.ticket_impact_by_reason(tickets, txn).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_registered_query_equals_the_unbucketed_one(spark):
    q = all_queries()
    for _ in range(2):           # the second one reads what the first has stored
        assert q["ticket_impact_bucketed"](spark, SF_SMALL).collect() == q["ticket_impact_by_reason"](spark, SF_SMALL).collect()


def record(i, **kw):
    base = dict(zip(TRANSACTION_COLUMNS, [f"TXN{i}", "2024-01-01 00:00:07", "1", "UPI", "Refund", "5.25", "INR", "Success", "", "210",
                                          "GatewayC", "North", "Web", "2", "0", "Fuel", "120", "33.5"]))
    return ",".join({**base, **kw}.values())


def test_bad_records_are_quarantined_with_file_line_and_reason(spark, tmpdir_path):
    header = ",".join(TRANSACTION_COLUMNS)
    rows = [record(i) for i in range(1000)]
    rows[10] = record(10, amount="much")
    rows[500] = "TXN500,2024-01-01 00:00:07"
    rows[999] = record(999) + ",surplus"
    os.makedirs(f"{tmpdir_path}/csv")
    for name, part in (("a.csv", rows[:600]), ("b.csv", rows[600:])):
        with open(f"{tmpdir_path}/csv/{name}", "w") as f:
            f.write("\n".join([header, *part]) + "\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")         # several splits a file
        good, bad = io.read_csv_quarantined(spark, f"{tmpdir_path}/csv", "transactions")
        assert good.columns == TRANSACTION_COLUMNS and good.count() == 997
        got = sorted((os.path.basename(r["file"]), r["line"], r["reason"], r["record"]) for r in bad.collect())
        assert got == [("a.csv", 12, "amount: much is no double", rows[10]), ("a.csv", 502, "fewer than 18 fields", rows[500]),
                       ("b.csv", 401, "more than 18 fields", rows[999])]
        assert sorted(good.collect()) == sorted(io.read_csv(spark, f"{tmpdir_path}/csv", "transactions").where(
            "false").union(good).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_strict_reading_stays_the_default(spark, tmpdir_path):
    import pytest
    with open(f"{tmpdir_path}/t.csv", "w") as f:
        f.write(",".join(TRANSACTION_COLUMNS) + "\n" + record(1, amount="much") + "\n")
    with pytest.raises(Exception):
        io.read_csv(spark, f"{tmpdir_path}/t.csv", "transactions").collect()


def test_quarantine_of_clean_and_empty_files(spark, tmpdir_path):
    for name, rows in (("clean", [record(1), record(2, failure_reason='"a, ""quoted"" reason"')]), ("empty", [])):
        path = f"{tmpdir_path}/{name}.csv"
        with open(path, "w") as f:
            f.write("\n".join([",".join(TRANSACTION_COLUMNS), *rows]) + "\n")
        good, bad = io.read_csv_quarantined(spark, path, "transactions")
        assert good.count() == len(rows) and bad.count() == 0
        assert sorted(good.collect()) == sorted(io.read_csv(spark, path, "transactions").collect())
    path = f"{tmpdir_path}/nameless.csv"
    with open(path, "w") as f:
        f.write("\n".join([",".join(TRANSACTION_COLUMNS), record(1, transaction_id="")]) + "\n")
    good, bad = io.read_csv_quarantined(spark, path, "transactions")
    assert good.count() == 0 and [r["reason"] for r in bad.collect()] == ["transaction_id is missing"]
