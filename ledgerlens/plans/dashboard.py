"""Datasets behind the operations dashboard, over the filtered frames.

These follow frame (not SQL) semantics: group keys that are null are left
out, rates are unrounded, and a missing failure reason (null, or the empty
string a Parquet source keeps) is not counted as a reason. Means of the
hours are taken over exact millionths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import core as fx


def kpi_summary(ftxn: DataFrame, ftickets: DataFrame) -> DataFrame:
    """Eight headline figures in one row; 0 instead of null for an empty view."""
    t = ftxn.agg(
        F.count(F.lit(1)).alias("total_txns"),
        F.count_if(F.col("status") == "Success").alias("_ok"),
        F.count_if(F.col("status") == "Failed").alias("_failed"),
        F.sum("processing_time_ms").alias("_pt_sum"),
        F.count("processing_time_ms").alias("_pt_n"),
    )
    k = ftickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.sum("sla_breached").alias("_br"), F.count("sla_breached").alias("_br_n"),
        F.sum(fx.units("resolution_time_hours")).alias("_res"), F.count("resolution_time_hours").alias("_res_n"),
        F.sum("csat_score").alias("_cs"), F.count("csat_score").alias("_cs_n"),
    )
    zero = F.lit(0.0)
    # One row beside one row.
    return t.crossJoin(F.broadcast(k)).select(
        "total_txns",
        F.coalesce(fx.pct("_ok", "total_txns"), zero).alias("success_rate"),
        F.coalesce(fx.pct("_failed", "total_txns"), zero).alias("failure_rate"),
        F.coalesce(fx.safe_div("_pt_sum", "_pt_n"), zero).alias("avg_proc_time"),
        "total_tickets",
        F.coalesce(fx.pct("_br", "_br_n"), zero).alias("sla_breach_rate"),
        F.coalesce(fx.mean_from_units("_res", "_res_n"), zero).alias("avg_resolution"),
        F.coalesce(fx.safe_div("_cs", "_cs_n"), zero).alias("avg_csat"),
    )


def daily_failure_trend(ftxn: DataFrame) -> DataFrame:
    agg = (ftxn.where(F.col("timestamp").isNotNull())
           .groupBy(F.to_date("timestamp").alias("date"))
           .agg(F.count("transaction_id").alias("total"),
                F.count_if(F.col("status") == "Failed").alias("failed")))
    rate = fx.safe_div(F.lit(100) * F.col("failed"), "total")
    return agg.select("date", "total", "failed", rate.alias("failure_rate_pct")).orderBy("date")


def gateway_performance(ftxn: DataFrame) -> DataFrame:
    agg = ftxn.where(F.col("gateway").isNotNull()).groupBy("gateway").agg(
        F.count("transaction_id").alias("total"),
        F.count_if(F.col("status") == "Success").alias("_ok"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("processing_time_ms").alias("_pt_sum"),
        F.count("processing_time_ms").alias("_pt_n"),
    )
    return agg.select(
        "gateway", "total", fx.pct("_ok", "_n").alias("success_rate"),
        fx.safe_div("_pt_sum", "_pt_n").alias("avg_proc"),
    ).orderBy("gateway")


def top_failure_reasons(ftxn: DataFrame, top_n: int = 10) -> DataFrame:
    return (ftxn.where((F.col("status") == "Failed") & fx.non_empty("failure_reason"))
            .groupBy("failure_reason").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "failure_reason").limit(top_n))


def regional_ops(ftxn: DataFrame) -> DataFrame:
    agg = ftxn.where(F.col("region").isNotNull()).groupBy("region").agg(
        F.count("transaction_id").alias("total"),
        F.count_if(F.col("status") == "Success").alias("_ok"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("is_fraud_flag").alias("fraud_flagged"),
    )
    return agg.select("region", "total", fx.pct("_ok", "_n").alias("success_rate"),
                      "fraud_flagged").orderBy("region")


def sla_heatmap(ftickets: DataFrame) -> DataFrame:
    agg = (ftickets.where(F.col("priority").isNotNull() & F.col("agent_team").isNotNull())
           .groupBy("priority", "agent_team")
           .agg(F.count("ticket_id").alias("total"), F.sum("sla_breached").alias("_b"),
                F.count("sla_breached").alias("_bn")))
    return agg.select("priority", "agent_team", "total",
                      fx.pct("_b", "_bn").alias("breach_rate")).orderBy("priority", "agent_team")


def resolution_distribution(ftickets: DataFrame) -> DataFrame:
    """Five-number summary of resolution hours per team (quartiles by linear
    interpolation). The exact percentile keeps one counter per distinct value
    per team; hours count in millionths, so that state is bounded by the value
    range, not by the row count, and it is merged map-side."""
    u = fx.units("resolution_time_hours")
    agg = (ftickets.where(F.col("agent_team").isNotNull() & F.col("resolution_time_hours").isNotNull())
           .groupBy("agent_team")
           .agg(F.min(u).alias("_min"), F.percentile(u, [0.25, 0.5, 0.75]).alias("_q"),
                F.max(u).alias("_max")))
    h = F.lit(float(fx.UNITS))
    return agg.select(
        "agent_team",
        (F.col("_min").cast("double") / h).alias("min"),
        (F.col("_q")[0] / h).alias("q1"),
        (F.col("_q")[1] / h).alias("median"),
        (F.col("_q")[2] / h).alias("q3"),
        (F.col("_max").cast("double") / h).alias("max"),
    ).orderBy("agent_team")


def csat_by_sla_outcome(ftickets: DataFrame) -> DataFrame:
    agg = (ftickets.where(F.col("sla_breached").isNotNull()).groupBy("sla_breached")
           .agg(F.sum("csat_score").alias("_s"), F.count("csat_score").alias("_n")))
    return agg.orderBy("sla_breached").select(
        fx.lookup(K.SLA_OUTCOME_LABELS, "sla_breached").alias("sla_outcome"),
        fx.safe_div("_s", "_n").alias("csat_score"),
    )


def bottleneck_agents(ftickets: DataFrame, min_tickets: int = K.AGENT_MIN_TICKETS,
                      top_n: int = 10) -> DataFrame:
    """Agents with at least ``min_tickets`` tickets, slowest (unrounded mean) first."""
    agg = (ftickets.where(F.col("agent_id").isNotNull() & F.col("agent_team").isNotNull())
           .groupBy("agent_id", "agent_team")
           .agg(F.count("ticket_id").alias("tickets"),
                F.sum(fx.units("resolution_time_hours")).alias("_rc"),
                F.count("resolution_time_hours").alias("_rn"),
                F.sum("sla_breached").alias("breaches")))
    return (agg.where(F.col("tickets") >= min_tickets)
            .select("agent_id", "agent_team", "tickets",
                    fx.mean_from_units("_rc", "_rn").alias("avg_resolution"), "breaches")
            .orderBy(F.desc("avg_resolution"), "agent_id", "agent_team").limit(top_n))
