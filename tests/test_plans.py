"""Plan shape: what the physical plans must (not) contain at any scale."""

import contextlib
import io

import pytest

from conftest import SF_SMALL
from ledgerlens.plans.registry import all_queries

QUERIES = all_queries()
# Their plans hold a Python fit or score; checked by their own tests.
MODEL_QUERIES = {n for n in QUERIES if n in ("isolation_forest_scores", "sampled_anomaly_view", "transaction_anomalies")
                 or n.startswith("top_") and n.endswith(("anomalies", "strict", "wide"))}
# One-row broadcast sides that carry statistics to the rows.
ONE_ROW_SIDES = {"zscore_priority_anomalies": 3, "zscore_transaction_anomalies": 3, "processing_time_outliers": 1,
                 "anomaly_reasons": 1, "kpi_summary": 1, "kpi_summary_filtered": 1, "cube_kpi_summary": 1, "zscore_flags": 1,
                 "amount_minmax": 1}


def plan_text(df, mode="simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_QUERIES))
def test_no_cartesian_no_unpartitioned_window(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text
    assert text.count("BroadcastNestedLoopJoin") == ONE_ROW_SIDES.get(name, 0)
    assert text.count("Subquery scalar-subquery") + text.count("ReusedSubquery") <= 3
    assert "Window" not in text


@pytest.mark.parametrize("name", ["sla_by_priority_team", "agent_efficiency", "enrich_sla"])
def test_tickets_without_links_read_no_transactions(spark, name):
    text = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "events.parquet" not in text and "customer.parquet" not in text


def test_hot_order_key_is_split(spark):
    """A third of all line items belong to one order."""
    from pyspark.sql import functions as F
    from ledgerlens.sources.conform import StarTables, support_tickets
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        t = StarTables.load(spark, SF_SMALL)
        hot = t.lineitem.withColumn("l_orderkey", F.when(F.pmod(F.hash("l_partkey", "l_linenumber"), F.lit(3)) == 0,
                                                         F.lit(1).cast("long")).otherwise(F.col("l_orderkey").cast("long")))
        t.__dict__["_frames"]["lineitem"] = hot
        df = support_tickets(t, links=False)
        assert df.count() == t.lineitem.count()
        df = df.select("ticket_id", "priority", "region")
        df.collect()
        assert "skew=true" in plan_text(df)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_event_ids_are_unique(spark):
    """What lets the link join be left out where its columns are not used."""
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert events.select("event_id").distinct().count() == events.count()


def test_nation_dimension_is_broadcast_even_with_small_threshold(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        text = plan_text(QUERIES["gateway_health"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    nation_joins = [l for l in text.splitlines() if "n_nationkey" in l and "Join" in l]
    assert nation_joins and all("BroadcastHashJoin" in l for l in nation_joins)


def test_view_filter_reaches_the_scan(spark):
    text = plan_text(QUERIES["filtered_transactions"](spark, SF_SMALL), "formatted")
    pushed = [l for l in text.splitlines() if l.startswith("PushedFilters") and "ts" in l]
    assert pushed and "GreaterThanOrEqual(ts" in pushed[0] and "LessThan(ts" in pushed[0]
    assert any(l.startswith("PushedFilters") and "In(r_name" in l for l in text.splitlines())


def test_columns_are_pruned_at_the_scan(spark):
    text = plan_text(QUERIES["regional_health"](spark, SF_SMALL))
    scan = [l for l in text.splitlines() if "FileScan parquet" in l and "events.parquet" in l]
    assert scan and "props" not in scan[0]


def test_single_statistics_are_scalar_subqueries(spark):
    from ledgerlens.operators.stats import minmax_norm
    from ledgerlens.sources.conform import conformed_transactions
    txn = conformed_transactions(spark, SF_SMALL)
    text = plan_text(txn.select("transaction_id", minmax_norm(txn, "amount").alias("norm_amount")))
    assert "Subquery" in text and "CartesianProduct" not in text and "NestedLoop" not in text
