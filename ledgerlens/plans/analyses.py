"""The nine named analyses over ``transactions`` and ``support_tickets``.

Each function is a lazy DataFrame plan (no action). Rounded figures use the
exact integer forms of ``functions.core`` so that they do not depend on the
order in which partial aggregates are merged. Every ORDER BY carries a
tie-breaker so that results and limits are total.

Shape at scale: all but ``ticket_impact_by_reason`` are one scan with a
partial (map-side) aggregate, so a hot group key costs nothing extra; the
join of that analysis is N:1 on the transaction id and shuffles both sides on
it unless AQE finds one side small enough to broadcast.
"""

from __future__ import annotations

import datetime as dt
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import core as fx
from ..operators import stats


def gateway_health(txn: DataFrame) -> DataFrame:
    agg = txn.groupBy("gateway").agg(
        F.count(F.lit(1)).alias("total_txns"),
        F.count_if(F.col("status") == "Success").alias("successful"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.sum("processing_time_ms").alias("_sum_pt"),
        F.count("processing_time_ms").alias("_n_pt"),
    )
    return agg.select(
        "gateway", "total_txns", "successful", "failed",
        fx.rate_pct_2dp("successful", "total_txns").alias("success_rate_pct"),
        fx.rate_pct_2dp("failed", "total_txns").alias("failure_rate_pct"),
        fx.ratio_half_up("_sum_pt", "_n_pt", 10).alias("avg_processing_time_ms"),
    ).orderBy(F.desc("failure_rate_pct"), F.asc("gateway"))


def failure_reasons(txn: DataFrame) -> DataFrame:
    failed = txn.where(F.col("status") == "Failed")
    # Denominator: all failed rows, also those without a reason (a scalar
    # subquery, evaluated once and inlined).
    all_failed = failed.agg(F.count(F.lit(1))).scalar()
    agg = (failed.where(fx.non_empty("failure_reason"))
           .groupBy("failure_reason").agg(F.count(F.lit(1)).alias("occurrences")))
    return agg.select(
        "failure_reason", "occurrences",
        fx.rate_pct_2dp("occurrences", all_failed).alias("pct_of_all_failures"),
    ).orderBy(F.desc("occurrences"), F.asc("failure_reason"))


def daily_throughput(txn: DataFrame) -> DataFrame:
    agg = txn.groupBy(F.to_date("timestamp").alias("txn_date")).agg(
        F.count(F.lit(1)).alias("total_txns"),
        F.count_if(F.col("status") == "Failed").alias("failed_txns"),
        *(e.alias(f"_{k}") for k, e in stats.moments("amount").items() if k in ("n", "s1")),
    )
    return agg.select(
        "txn_date", "total_txns", "failed_txns",
        fx.rate_pct_2dp("failed_txns", "total_txns").alias("failure_rate_pct"),
        fx.round_half_away(stats.mean_of({"n": F.col("_n"), "s1": F.col("_s1")}), 2).alias("avg_txn_amount"),
    ).orderBy("txn_date")


def _ticket_means() -> list:
    return [
        F.count(F.lit(1)).alias("_n"),
        F.sum(fx.units("resolution_time_hours")).alias("_res_units"),
        F.count("resolution_time_hours").alias("_n_res"),
        F.sum("csat_score").alias("_csat_sum"),
        F.count("csat_score").alias("_n_csat"),
    ]


def sla_by_priority_team(tickets: DataFrame) -> DataFrame:
    agg = tickets.groupBy("priority", "agent_team").agg(
        *_ticket_means(), F.sum("sla_breached").alias("breached_tickets"))
    return agg.select(
        "priority", "agent_team",
        F.col("_n").alias("total_tickets"),
        "breached_tickets",
        fx.rate_pct_2dp("breached_tickets", "_n").alias("sla_breach_rate_pct"),
        fx.mean_2dp_from_units("_res_units", "_n_res").alias("avg_resolution_hours"),
        fx.ratio_half_up("_csat_sum", "_n_csat", 100).alias("avg_csat"),
    ).orderBy(F.desc("sla_breach_rate_pct"), "priority", "agent_team")


def agent_efficiency(tickets: DataFrame, min_tickets: int = K.AGENT_MIN_TICKETS,
                     top_n: int = 20) -> DataFrame:
    agg = tickets.groupBy("agent_id", "agent_team").agg(
        *_ticket_means(),
        F.sum("sla_breached").alias("sla_breaches"),
        F.sum("escalation_flag").alias("escalations"),
    )
    return (agg.where(F.col("_n") >= min_tickets).select(
        "agent_id", "agent_team",
        F.col("_n").alias("tickets_handled"),
        fx.mean_2dp_from_units("_res_units", "_n_res").alias("avg_resolution_hours"),
        "sla_breaches", "escalations",
        fx.ratio_half_up("_csat_sum", "_n_csat", 100).alias("avg_csat"),
    ).orderBy(F.desc("avg_resolution_hours"), "agent_id", "agent_team").limit(top_n))


def ticket_impact_by_reason(tickets: DataFrame, txn: DataFrame) -> DataFrame:
    s = tickets.where(fx.non_empty("related_transaction_id")).select(
        "ticket_id", "related_transaction_id", "resolution_time_hours", "csat_score")
    t = txn.select("transaction_id", "failure_reason")
    joined = s.join(t, s.related_transaction_id == t.transaction_id, "inner")
    agg = joined.groupBy("failure_reason").agg(
        F.count_distinct("ticket_id").alias("tickets_generated"),
        F.sum(fx.units("resolution_time_hours")).alias("_res_units"),
        F.count("resolution_time_hours").alias("_n_res"),
        F.sum("csat_score").alias("_csat_sum"),
        F.count("csat_score").alias("_n_csat"),
    )
    return agg.select(
        "failure_reason", "tickets_generated",
        fx.mean_2dp_from_units("_res_units", "_n_res").alias("avg_resolution_hours"),
        fx.ratio_half_up("_csat_sum", "_n_csat", 100).alias("avg_csat"),
    ).orderBy(F.desc("tickets_generated"), F.asc_nulls_first("failure_reason"))


def sla_risk(tickets: DataFrame, as_of: str | dt.datetime | None = None) -> DataFrame:
    """Open tickets against their SLA at ``as_of`` (default: now, UTC-naive).

    The status compares the unrounded elapsed time (exact microseconds) with
    the target; only the displayed hours are rounded.
    """
    # "now" is the UTC wall clock, whatever the session zone.
    now = (F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
           if as_of is None else F.lit(str(as_of)).cast("timestamp_ntz"))
    micros = fx.micros_between("created_at", now)
    target_us = F.col("sla_target_hours").cast("long") * F.lit(fx.HOUR_MICROS)
    breached, at_risk, on_track = K.SLA_RISK_LABELS
    part, whole = Fraction(str(K.SLA_AT_RISK_SHARE)).as_integer_ratio()
    status = (F.when(micros > target_us, F.lit(breached))
              .when(micros * F.lit(whole) > target_us * F.lit(part), F.lit(at_risk))
              .otherwise(F.lit(on_track)))
    return (tickets.where(F.col("status") == "Pending").select(
        "ticket_id", "priority", "agent_team", "created_at", "sla_target_hours",
        fx.hours_between_2dp("created_at", now).alias("hours_open"),
        status.alias("sla_risk_status"),
    ).orderBy(F.desc("hours_open"), "ticket_id"))


def processing_time_outliers(txn: DataFrame, threshold: float = K.OUTLIER_Z,
                             top_n: int = 100) -> DataFrame:
    """Transactions whose processing time is more than ``threshold`` population
    standard deviations from the mean; the 100 highest z-scores."""
    rows, z = stats.with_population_z(txn.select("transaction_id", "gateway", "processing_time_ms"), "processing_time_ms")
    return (rows.where(z.beyond(threshold)).withColumn("_z", z.z)
            .select("transaction_id", "gateway", "processing_time_ms",
                    fx.round_half_away("_z", 2).alias("z_score"))
            .orderBy(F.desc("z_score"), "transaction_id").limit(top_n))


def regional_health(txn: DataFrame) -> DataFrame:
    agg = txn.groupBy("region").agg(
        F.count(F.lit(1)).alias("total_txns"),
        F.count_if(F.col("status") == "Success").alias("_ok"),
        F.sum("is_fraud_flag").alias("fraud_flagged_txns"),
    )
    return agg.select(
        "region", "total_txns",
        fx.rate_pct_2dp("_ok", "total_txns").alias("success_rate_pct"),
        "fraud_flagged_txns",
    ).orderBy(F.asc("success_rate_pct"), "region")
