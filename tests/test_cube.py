"""The ten additive datasets from the cube equal those over rows, under any view filter, and read no row."""

import datetime as dt

import pytest
from conftest import SF_SMALL
from frames import ticket_frame, txn_frame
from pyspark.sql import functions as F

from ledgerlens.operators.filters import ViewFilter, filter_domains, filter_tickets, filter_transactions
from ledgerlens.operators.numbering import dense_numbers
from ledgerlens.plans import build, cube, dashboard
from ledgerlens.plans.analyses import ticket_impact_by_reason
from ledgerlens.plans.registry import stored_datasets
from ledgerlens.sources.conform import conformed_tables
from ledgerlens.sources.snapshots import open_snapshot

VIEWS = [ViewFilter(), ViewFilter("2024-01-08", "2024-01-21", ("AMERICA", "ASIA"), ("GatewayA", "GatewayC")),
         ViewFilter("2024-01-03", "2024-01-03"), ViewFilter(regions=["EUROPE"]), ViewFilter(gateways=["GatewayB"]),
         ViewFilter(regions=[]), ViewFilter("2024-01-05", None, gateways=[]), ViewFilter("2030-01-01", "2030-01-02")]


def over_rows(name, txn, tickets, f):
    if name == "filter_domains":
        return filter_domains(txn)
    ftxn, ftk = filter_transactions(txn, f), filter_tickets(tickets, txn, f)
    make = getattr(dashboard, name)
    if name == "kpi_summary":
        return make(ftxn, ftk)
    return make(ftxn if name in ("daily_failure_trend", "gateway_performance", "top_failure_reasons", "regional_ops") else ftk)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cube"))
    build.build_tables(spark, SF_SMALL, root)
    txn, tickets = conformed_tables(spark, SF_SMALL)
    return root, txn.cache(), tickets.cache()


@pytest.mark.parametrize("f", VIEWS, ids=str)
def test_equal_to_rows(spark, stored, f):
    root, txn, tickets = stored
    states = build.load_cube(spark, root)
    for name in cube.DATASETS:
        got = getattr(states, name)() if name == "filter_domains" else getattr(states, name)(f)
        want = over_rows(name, txn, tickets, f)
        assert got.columns == want.columns and [x.dataType for x in got.schema] == [x.dataType for x in want.schema], name
        assert got.collect() == want.collect(), name


def test_no_row_table_is_read(spark, stored):
    root, _, _ = stored
    for name, make in stored_datasets(spark, root, VIEWS[1]).items():
        plan = make()._jdf.queryExecution().executedPlan().toString()
        assert ("transaction_id" in plan or "ticket_id" in plan) == name.startswith("filtered_"), name


def test_odd_rows(spark):
    """Null keys, null figures, empty reasons and rows without a time."""
    at = dt.datetime(2024, 1, 2)
    txn = txn_frame(spark, [{"region": None}, {"gateway": None, "timestamp": at}, {"timestamp": None}, {"status": None},
                            {"status": "Failed", "failure_reason": ""}, {"status": "Failed", "failure_reason": "x", "timestamp": at},
                            {"status": "Failed", "failure_reason": None}, {"processing_time_ms": None, "is_fraud_flag": None}])
    tickets = ticket_frame(spark, [{"priority": None}, {"agent_team": None}, {"agent_id": None}, {"sla_breached": None},
                                   {"resolution_time_hours": None, "csat_score": None}, {"created_at": None}, {"created_at": at},
                                   {"region": None}] + [{"agent_id": "A1", "resolution_time_hours": i / 3} for i in range(25)])
    for t, k in ((txn, tickets), (txn.limit(0), tickets.limit(0))):
        states = cube.Cube(*cube.states_of(t, k).values())
        for f in (ViewFilter(), ViewFilter("2024-01-02", "2024-01-03"), ViewFilter(regions=["North"])):
            for name in cube.DATASETS:
                got = getattr(states, name)() if name == "filter_domains" else getattr(states, name)(f)
                assert got.collect() == over_rows(name, t, k, f).collect(), (name, f)


@pytest.mark.parametrize("f", VIEWS, ids=str)
def test_distinct_tickets_from_bitmaps(spark, stored, f):
    root, txn, tickets = stored
    if "impact_states" not in open_snapshot(spark, root).tables:
        with pytest.raises(ValueError, match="store_impact"):
            build.load_cube(spark, root).ticket_impact_by_reason()
        build.store_impact(spark, root)
    got = build.load_cube(spark, root).ticket_impact_by_reason(f)
    want = ticket_impact_by_reason(tickets if f == ViewFilter() else filter_tickets(tickets, txn, f), txn)
    assert got.columns == want.columns and got.collect() == want.collect()


def test_a_ticket_counts_once(spark):
    """Repeated tickets, links without a transaction, null and empty links, more numbers than a bucket has."""
    txn = txn_frame(spark, [{"transaction_id": f"T{i}", "failure_reason": (None, "", "x", "y")[i % 4]} for i in range(8)])
    rows = [{"ticket_id": f"K{i % 5}", "related_transaction_id": f"T{i % 9}", "region": ("North", None)[i % 2]} for i in range(60)]
    rows += [{"ticket_id": "K9", "related_transaction_id": x} for x in (None, "", "nowhere")]
    tickets = ticket_frame(spark, rows)
    states = cube.Cube(*cube.states_of(txn, tickets).values(), cube.impact_states(txn, tickets))
    assert states.ticket_impact_by_reason().collect() == ticket_impact_by_reason(tickets, txn).collect()


def test_dense_numbers(spark):
    df = spark.createDataFrame([(f"k{i % 5000}", i % 7, i) for i in range(12_000)] + [(None, 1, 1)], "k string, a int, b int")
    got = {r["k"]: r["no"] for r in dense_numbers(df, "k", ["a"]).collect()}
    least = {}
    for i in range(12_000):
        least[f"k{i % 5000}"] = min(least.get(f"k{i % 5000}", 9), i % 7)
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(least, key=lambda k: (least[k], k))
    assert sorted(got.values()) == list(range(1, 5001)) and dense_numbers(df.limit(0), "k", ["a"]).count() == 0


def test_replaced_days_leave_no_stale_impact(spark, tmpdir_path):
    txn = txn_frame(spark, [{"transaction_id": "T1", "failure_reason": "x"}])
    tickets = ticket_frame(spark, [{"related_transaction_id": "T1"}])
    build._build(spark, {"transactions": txn, "support_tickets": tickets}, tmpdir_path, True)
    build.store_impact(spark, tmpdir_path)
    assert build.load_cube(spark, tmpdir_path).ticket_impact_by_reason().first()["tickets_generated"] == 1
    build.replace_days(spark, tmpdir_path, support_tickets=tickets.union(ticket_frame(spark, [{"related_transaction_id": "T1"}] * 3)))
    assert build.load_cube(spark, tmpdir_path).impact_states is None
    build.store_impact(spark, tmpdir_path)
    stored_txn, stored_tickets = build.load_tables(spark, tmpdir_path)
    assert build.load_cube(spark, tmpdir_path).ticket_impact_by_reason().collect() == ticket_impact_by_reason(
        stored_tickets, stored_txn).collect()


def test_stored_cube_derives_each_table_once(spark, monkeypatch, tmpdir_path):
    """All states read columns that were stored once: none of their plans has the joins of the star tables."""
    from ledgerlens.plans import registry

    plans, states_of = [], cube.states_of

    def seen(txn, tickets):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (txn, tickets))
        return states_of(txn, tickets)

    monkeypatch.setattr(cube, "states_of", seen)
    monkeypatch.setattr(registry.io, "files_version", lambda *a: "derived_once")
    got = registry.stored_cube(spark, SF_SMALL).csat_by_sla_outcome().collect()
    assert len(plans) == 2 and not any("Join" in p for p in plans) and len(got) == 2


def test_ticket_inputs_keep_the_states(spark):
    """Ids are stored for linked tickets only; a missing id stays missing."""
    given = spark.createDataFrame([("t1", "x1"), ("t2", ""), ("t3", None), (None, "x2"), (None, None)], "ticket_id string, related_transaction_id string")
    others = {c: "int" for c in cube.TICKET_INPUTS if c not in given.columns}
    rows = cube.ticket_inputs(given.select("*", *(F.lit(1).cast(t).alias(c) for c, t in others.items()))).collect()
    assert [r["ticket_id"] for r in rows] == ["t1", "", "", None, None]
