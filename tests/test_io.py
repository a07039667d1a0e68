"""CSV and Parquet round trips keep schema, rows and nulls; source choice."""

import os

from frames import ticket_frame, txn_frame
from ledgerlens.sources import io
from ledgerlens.sources.schemas import SUPPORT_TICKETS, TRANSACTIONS
import datetime as dt


def test_csv_round_trip(spark, tmpdir_path):
    tk = ticket_frame(spark, [{"resolved_at": dt.datetime(2024, 1, 2, 3, 4, 5, 678000)},
                              {"related_transaction_id": "TXN100001"}, {}])
    path = os.path.join(tmpdir_path, "support_tickets.csv")
    io.write_csv(tk, path)
    back = io.read_csv(spark, path, "support_tickets")
    assert back.schema == SUPPORT_TICKETS or [f.name for f in back.schema] == [f.name for f in SUPPORT_TICKETS]
    assert sorted(back.collect()) == sorted(tk.collect())


def test_parquet_round_trip_and_source_choice(spark, tmpdir_path):
    """Both tables come from storage, or both from CSV."""
    txn = txn_frame(spark, [{"failure_reason": None}, {"status": "Failed", "failure_reason": "OTP Expired"}])
    tk = ticket_frame(spark, [{}])
    tables, csv = os.path.join(tmpdir_path, "tables"), os.path.join(tmpdir_path, "csv")
    io.write_csv(txn.limit(1), os.path.join(csv, "transactions.csv"))
    io.write_csv(tk, os.path.join(csv, "support_tickets.csv"))
    io.write_table(txn, os.path.join(tables, "transactions"), partition_by_date="timestamp")
    t, k = io.load_data(spark, tables, csv)
    assert (t.count(), k.count()) == (1, 1) and "_date" not in t.columns
    io.write_table(tk, os.path.join(tables, "support_tickets"))
    t, k = io.load_data(spark, tables, csv)
    assert [f.name for f in t.drop("_date").schema] == [f.name for f in TRANSACTIONS]
    assert sorted(t.drop("_date").collect()) == sorted(txn.collect())
    audit = {r["table"]: r["rows"] for r in io.load_audit(t, k).collect()}
    assert audit == {"transactions": 2, "support_tickets": 1}


def test_a_table_that_cannot_be_read_is_an_error(spark, tmpdir_path):
    import pytest
    from pyspark.errors import AnalysisException
    for name in ("transactions", "support_tickets"):
        os.makedirs(os.path.join(tmpdir_path, "tables", name))
    with pytest.raises(AnalysisException):
        io.load_data(spark, os.path.join(tmpdir_path, "tables"), os.path.join(tmpdir_path, "csv"))


def test_written_files_read_by_another_engine(spark, tmpdir_path):
    """Every value of the written Parquet and CSV, read by DuckDB; stored rows in time order."""
    import duckdb
    from compare import _norm
    from conftest import SF_SMALL
    from ledgerlens.sources.conform import conformed_tables

    con = duckdb.connect()
    for name, df in zip(io.SCHEMAS, conformed_tables(spark, SF_SMALL)):
        want = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=str)
        by_day, flat, csv = (os.path.join(tmpdir_path, name, kind) for kind in ("by_day", "flat", "csv"))
        io.write_table(df, by_day, "timestamp" if name == "transactions" else "created_at", io.ORDER_KEYS[name])
        io.write_table(df, flat, order=io.ORDER_KEYS[name])
        io.write_csv(df, csv)
        cols = ", ".join(f'"{c}"' for c in df.columns)
        for path in (f"read_parquet('{by_day}/*/*.parquet', hive_partitioning=true)", f"read_parquet('{flat}/*.parquet')"):
            got = [tuple(_norm(v) for v in r) for r in con.execute(f"SELECT {cols} FROM {path}").fetchall()]
            assert sorted(got, key=str) == want
        types = {f.name: {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "int": "INTEGER",
                          "bigint": "BIGINT"}[f.dataType.simpleString()] for f in df.schema}
        got = con.execute(f"SELECT {cols} FROM read_csv('{csv}/*.csv', header=true, columns={types})").fetchall()
        plain = lambda rows: sorted((tuple(None if v == "" else _norm(v) for v in r) for r in rows), key=str)
        assert plain(got) == plain(want)
        time = io.ORDER_KEYS[name][0]
        files = con.execute(f"SELECT filename, list({time}) FROM read_parquet('{flat}/*.parquet', filename=true) GROUP BY 1 ORDER BY 1").fetchall()
        times = [t for _, ts in files for t in ts]
        assert times == sorted(times)


def test_rewritten_files_are_read_anew(spark, tmpdir_path):
    """The same path with another schema, and a dimension that has grown."""
    from pyspark.sql import functions as F
    from ledgerlens.operators.joins import bounded_broadcast
    from ledgerlens.sources.conform import StarTables

    spark.range(3).select(F.col("id").alias("a")).write.parquet(os.path.join(tmpdir_path, "events.parquet"))
    assert StarTables.load(spark, tmpdir_path).events.columns == ["a"]
    spark.range(5).select(F.col("id").alias("b")).write.mode("overwrite").parquet(os.path.join(tmpdir_path, "events.parquet"))
    assert StarTables.load(spark, tmpdir_path).events.columns == ["b"]
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    read = lambda: spark.read.parquet(os.path.join(tmpdir_path, "events.parquet"))
    assert hinted(bounded_broadcast(read(), max_rows=10))
    spark.range(50).select(F.col("id").alias("b")).write.mode("overwrite").parquet(os.path.join(tmpdir_path, "events.parquet"))
    assert not hinted(bounded_broadcast(read(), max_rows=10))


def test_preview_order(spark):
    txn = txn_frame(spark, [{"timestamp": dt.datetime(2024, 1, 3)}, {"timestamp": dt.datetime(2024, 1, 1)},
                            {"timestamp": dt.datetime(2024, 1, 2)}])
    got = [r["transaction_id"] for r in io.preview(txn, "transactions", rows=2).collect()]
    assert got == ["TXN100001", "TXN100002"]


def test_build_and_load_stored_tables_prunes_days(spark, tmpdir_path):
    import contextlib
    import io as _io

    from conftest import SF_SMALL
    from ledgerlens.operators.filters import ViewFilter, filter_tickets, filter_transactions
    from ledgerlens.plans.build import build_tables, load_tables
    from ledgerlens.sources.conform import conformed_tables

    audit = {r["table"]: r["rows"] for r in build_tables(spark, SF_SMALL, tmpdir_path).collect()}
    txn0, tk0 = conformed_tables(spark, SF_SMALL)
    assert audit == {"transactions": txn0.count(), "support_tickets": tk0.count()}
    txn, tk = load_tables(spark, tmpdir_path)
    f = ViewFilter("2024-01-08", "2024-01-21", regions=["ASIA", "EUROPE"], gateways=["GatewayA"])
    got = filter_transactions(txn, f)
    want = filter_transactions(txn0, f)
    assert sorted(got.collect()) == sorted(want.collect())
    assert sorted(filter_tickets(tk, txn, f).collect()) == \
        sorted(filter_tickets(tk0, txn0, f).collect())
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        filter_transactions(txn, f).explain("formatted")
    assert any(l.startswith("PartitionFilters") and "_date" in l for l in buf.getvalue().splitlines())


def test_csv_as_written_by_a_frame_library(spark, tmpdir_path):
    from ledgerlens.sources.schemas import TRANSACTION_COLUMNS
    header = ",".join(TRANSACTION_COLUMNS)
    rows = [
        "TXN100000,2024-01-01 00:00:07.179575,100001,UPI,Refund,512.25,INR,Failed,Gateway Timeout,2100,GatewayC,North,Web,2,0,Fuel,120,33.5",
        "TXN100001,2024-01-01 00:03:52,100002,Card,Refund,12.0,INR,Success,,310,GatewayA,South,iOS,0,0,Travel,3000,8.1",
        "TXN100002,2024-01-01 00:04:00.5,100003,POS,Loan EMI,99.99,INR,Pending,,280,GatewayB,East,Android,0,1,P2P,15,71.2",
    ]
    path = os.path.join(tmpdir_path, "transactions.csv")
    with open(path, "w") as f:
        f.write(header + "\n" + "\n".join(rows) + "\n")
    df = io.read_csv(spark, path, "transactions")
    got = {r["transaction_id"]: r for r in df.collect()}
    assert got["TXN100000"]["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 7, 179575)
    assert got["TXN100001"]["timestamp"] == dt.datetime(2024, 1, 1, 0, 3, 52)
    assert got["TXN100002"]["timestamp"] == dt.datetime(2024, 1, 1, 0, 4, 0, 500000)
    assert got["TXN100001"]["failure_reason"] is None        # empty field reads as null
    assert got["TXN100002"]["is_fraud_flag"] == 1 and got["TXN100000"]["risk_score"] == 33.5


def test_build_from_csv_round_trip(spark, tmpdir_path):
    from conftest import SF_SMALL
    from ledgerlens.plans.build import build_from_csv, load_tables
    from ledgerlens.sources.conform import conformed_tables

    txn, tk = conformed_tables(spark, SF_SMALL)
    io.write_csv(txn, os.path.join(tmpdir_path, "csv", "transactions.csv"))
    io.write_csv(tk, os.path.join(tmpdir_path, "csv", "support_tickets.csv"))
    audit = {r["table"]: r["rows"] for r in
             build_from_csv(spark, os.path.join(tmpdir_path, "csv"), os.path.join(tmpdir_path, "tables")).collect()}
    assert audit == {"transactions": txn.count(), "support_tickets": tk.count()}
    t, k = load_tables(spark, os.path.join(tmpdir_path, "tables"))
    # '' and null both read back as null from CSV (as a frame library reads them).
    norm = lambda df: sorted(df.drop("_date").na.replace("", None).collect()) if "_date" in df.columns \
        else sorted(df.na.replace("", None).collect())
    assert norm(t) == norm(txn)


def test_dashboard_over_stored_tables_equals_registered_queries(spark, tmpdir_path):
    from conftest import SF_SMALL
    from ledgerlens.plans.build import build_tables, load_tables
    from ledgerlens.plans.registry import all_queries, dashboard_over

    build_tables(spark, SF_SMALL, tmpdir_path).collect()
    txn, tk = load_tables(spark, tmpdir_path)
    queries = all_queries()
    reused = dashboard_over(txn, tk, reuse=True)
    for name, make in dashboard_over(txn, tk).items():
        got = make()
        want = queries[name](spark, SF_SMALL)
        assert got.columns == want.columns, name
        assert sorted(got.collect()) == sorted(want.collect()) == sorted(reused[name]().collect()), name
    spark.catalog.clearCache()
