"""Stored versions: both tables at once or not at all, pinned readers, days replaced, old versions expired."""

import datetime as dt
import os

import pytest
from frames import ticket_frame, txn_frame
from pyspark.sql import functions as F

from ledgerlens.plans import build
from ledgerlens.sources import io, snapshots


def pair(spark, day, n):
    """``n`` transactions and ``n`` tickets on a day of January 2024."""
    at = dt.datetime(2024, 1, day, 10)
    return (txn_frame(spark, [{"transaction_id": f"T{day}-{i}", "timestamp": at} for i in range(n)]),
            ticket_frame(spark, [{"ticket_id": f"K{day}-{i}", "created_at": at} for i in range(n)]))


def store(spark, root, *pairs, by_day=True):
    txn, tickets = pairs[0]
    for t, k in pairs[1:]:
        txn, tickets = txn.union(t), tickets.union(k)
    return build._build(spark, {"transactions": txn, "support_tickets": tickets}, root, by_day)


def ids(frames):
    txn, tickets = frames
    return (sorted(r[0] for r in txn.select("transaction_id").collect()), sorted(r[0] for r in tickets.select("ticket_id").collect()))


def test_a_build_that_dies_between_the_tables_leaves_the_old_pair(spark, tmpdir_path, monkeypatch):
    store(spark, tmpdir_path, pair(spark, 1, 2))
    before = ids(io.load_stored(spark, tmpdir_path))
    write, calls = io.write_table, []

    def dying(df, path, *args, **kw):
        calls.append(path)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return write(df, path, *args, **kw)

    monkeypatch.setattr(io, "write_table", dying)
    with pytest.raises(KeyboardInterrupt):
        store(spark, tmpdir_path, pair(spark, 2, 5))
    monkeypatch.undo()
    assert len(calls) == 2 and os.path.isdir(calls[0])
    assert ids(io.load_stored(spark, tmpdir_path)) == before == (["T1-0", "T1-1"], ["K1-0", "K1-1"])
    # Its part stays while a build may be writing it, and goes later.
    assert snapshots.expire(spark, tmpdir_path) == []
    assert snapshots.expire(spark, tmpdir_path, grace_seconds=0) == [os.path.relpath(calls[0], tmpdir_path)]
    assert ids(io.load_stored(spark, tmpdir_path)) == before


def test_readers_keep_their_version(spark, tmpdir_path):
    store(spark, tmpdir_path, pair(spark, 1, 2))
    old = io.load_stored(spark, tmpdir_path)
    first = ids(old)
    for n in (3, 4):
        store(spark, tmpdir_path, pair(spark, 2, n))
        assert ids(old) == first
    assert len(ids(io.load_stored(spark, tmpdir_path))[0]) == 4
    assert ids(io.load_stored(spark, tmpdir_path, version=1)) == first
    assert len(ids(io.load_stored(spark, tmpdir_path, version=2))[1]) == 3


def test_old_versions_expire(spark, tmpdir_path):
    for n in (1, 2, 3):
        store(spark, tmpdir_path, pair(spark, 1, n))
    gone = snapshots.expire(spark, tmpdir_path, keep=2, grace_seconds=0)
    assert len(gone) == 5 and len(os.listdir(f"{tmpdir_path}/parts")) == 10
    assert len(ids(io.load_stored(spark, tmpdir_path, version=2))[0]) == 2 and len(ids(io.load_stored(spark, tmpdir_path))[0]) == 3
    with pytest.raises(Exception):
        io.load_stored(spark, tmpdir_path, version=1)
    assert snapshots.expire(spark, tmpdir_path, keep=2, grace_seconds=0) == []


def test_of_two_builds_of_one_version_the_second_fails(spark, tmpdir_path):
    store(spark, tmpdir_path, pair(spark, 1, 1))
    base = snapshots.open_snapshot(spark, tmpdir_path)
    snapshots.publish(spark, tmpdir_path, {}, base)
    with pytest.raises(Exception, match="exist"):
        snapshots.publish(spark, tmpdir_path, {}, base)
    assert snapshots.open_snapshot(spark, tmpdir_path).version == 2
    assert not [n for n in os.listdir(f"{tmpdir_path}/manifests") if n.endswith(".draft")]


def test_the_audit_needs_no_scan(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(io, "load_audit", lambda *a: 1 / 0)
    got = store(spark, tmpdir_path, pair(spark, 1, 3), pair(spark, 5, 4), by_day=False)
    assert {r["table"]: r["rows"] for r in got.collect()} == {"transactions": 7, "support_tickets": 7}
    assert "Scan parquet" not in got._jdf.queryExecution().toString()
    figures = snapshots.open_snapshot(spark, tmpdir_path).figures("transactions")
    assert figures == [{"rows": 7, "first": "2024-01-01 10:00:00", "last": "2024-01-05 10:00:00"}]


@pytest.mark.parametrize("by_day", [True, False])
def test_empty_tables(spark, tmpdir_path, by_day):
    txn, tickets = pair(spark, 1, 1)
    got = store(spark, tmpdir_path, (txn.limit(0), tickets.limit(0)), by_day=by_day)
    assert {r["rows"] for r in got.collect()} == {0}
    assert ids(io.load_stored(spark, tmpdir_path)) == ([], [])
    assert build.load_cube(spark, tmpdir_path).kpi_summary().first()["total_txns"] == 0


def test_days_are_replaced_in_rows_and_cube(spark, tmpdir_path):
    no_time = txn_frame(spark, [{"transaction_id": "never", "timestamp": None}])
    first = [pair(spark, d, 3) for d in (1, 2, 3)]
    first[0] = (first[0][0].union(no_time), first[0][1])
    store(spark, tmpdir_path, *first)
    old = io.load_stored(spark, tmpdir_path)
    was = ids(old)
    t2, k2 = pair(spark, 2, 5)
    t9, k9 = pair(spark, 9, 1)
    written = build.replace_days(spark, tmpdir_path, t2.union(t9), k2.union(k9))
    txn, tickets = io.load_stored(spark, tmpdir_path)
    assert {r["_date"] and r["_date"].day: r["count"] for r in txn.groupBy("_date").count().collect()} == {1: 3, 2: 5, 3: 3, 9: 1, None: 1}
    assert tickets.count() == 12 and ids(old) == was
    assert {r["table"]: r["rows"] for r in build.audit(written).collect()} == {"transactions": 13, "support_tickets": 12}
    trend = {r["date"].day: r["total"] for r in build.load_cube(spark, tmpdir_path).daily_failure_trend().collect()}
    assert trend == {1: 3, 2: 5, 3: 3, 9: 1}
    # Only the new days' rows were written, and the old part keeps its files.
    new = [p for p in written.tables["transactions"] if p.whole]
    assert [set(p.days) for p in new] == [{"2024-01-02", "2024-01-09"}]
    # A table alone, and the same days once more.
    build.replace_days(spark, tmpdir_path, support_tickets=pair(spark, 2, 1)[1])
    assert io.load_stored(spark, tmpdir_path)[1].count() == 8 and io.load_stored(spark, tmpdir_path)[0].count() == 13
    plan = io.load_stored(spark, tmpdir_path)[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cast(_date" in plan or "PartitionFilters: [_date" in plan or "_date" in plan.split("PartitionFilters")[1]


def test_a_table_not_stored_by_day_is_not_replaced_by_days(spark, tmpdir_path):
    store(spark, tmpdir_path, pair(spark, 1, 1), by_day=False)
    with pytest.raises(ValueError, match="not stored by day"):
        build.replace_days(spark, tmpdir_path, pair(spark, 1, 2)[0])


def test_load_data_prefers_a_snapshot(spark, tmpdir_path):
    store(spark, f"{tmpdir_path}/tables", pair(spark, 4, 2))
    txn, tickets = io.load_data(spark, f"{tmpdir_path}/tables", f"{tmpdir_path}/nowhere")
    assert (txn.count(), tickets.count()) == (2, 2) and txn.where(F.col("_date") == "2024-01-04").count() == 2
