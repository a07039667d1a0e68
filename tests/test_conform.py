"""Conformed tables: both engines agree; facts of FIXTURES.md §3 hold."""

import pytest
from pyspark.sql import functions as F

from compare import compare, duck_connection
from conftest import SF_MID, SF_SMALL
from ledgerlens.plans.oracle_sql import with_conform
from ledgerlens.sources.conform import conformed_tables
from ledgerlens.sources.schemas import SUPPORT_TICKETS, TRANSACTIONS


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_conformed_tables_match_duckdb(spark, sf):
    txn, tk = conformed_tables(spark, sf)
    con = duck_connection(sf)
    assert compare(txn, con, with_conform("SELECT * FROM transactions"))[0]
    assert compare(tk, con, with_conform("SELECT * FROM support_tickets"))[0]


def test_schemas(spark):
    txn, tk = conformed_tables(spark, SF_SMALL)
    assert [f.name for f in txn.schema] == [f.name for f in TRANSACTIONS]
    assert [f.dataType for f in txn.schema] == [f.dataType for f in TRANSACTIONS]
    assert [f.name for f in tk.schema] == [f.name for f in SUPPORT_TICKETS]
    assert [f.dataType for f in tk.schema] == [f.dataType for f in SUPPORT_TICKETS]
    assert len(txn.columns) == 18 and len(tk.columns) == 18


def test_facts_sf001(spark):
    txn, tk = conformed_tables(spark, SF_MID)
    assert txn.count() == 10000 and txn.select("transaction_id").distinct().count() == 10000
    assert tk.count() == 60000 and tk.select("ticket_id").distinct().count() == 60000
    by_status = {r["status"]: r["count"] for r in txn.groupBy("status").count().collect()}
    assert by_status == {"Success": 7717, "Failed": 2014, "Reversed": 114, "Pending": 155}
    assert txn.where((F.col("status") == "Failed") & (F.col("failure_reason") == "")).count() == 53
    linked = tk.where(F.col("related_transaction_id").startswith("TXN")).count()
    assert linked == 8502
