"""Derivation rules of the operational tables, as column transforms.

These are the deterministic business rules that produce the SLA, resolution,
risk and link columns; each is a built-in expression evaluated row by row in
generated code (no shuffle), except ``failure_expectation`` (one partial
aggregate) and the link helpers (a filter with a seeded exact-size sample,
and a labelled pass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import core as fx
from .quantile import hash_sample


def sla_target_hours(priority) -> Column:
    return fx.lookup(K.SLA_TARGET_BY_PRIORITY, priority).cast("int")


def sla_breached(resolution_hours, target_hours) -> Column:
    """1 when the resolution took strictly longer than the target."""
    return fx.flag(fx._c(resolution_hours) > fx._c(target_hours))


def enrich_sla(tickets: DataFrame, priority: str = "priority",
               resolution: str = "resolution_time_hours") -> DataFrame:
    return (tickets.withColumn("sla_target_hours", sla_target_hours(priority))
            .withColumn("sla_breached", sla_breached(resolution, "sla_target_hours")))


def team_penalty_hours(team) -> Column:
    return fx.lookup(K.TEAM_PENALTY_HOURS, team, default=0.0)


def resolution_time(base_hours, team, target_hours, digits: int | None = 2) -> Column:
    """base + team penalty + 0.15·target, rounded half to even (``None``: unrounded)."""
    x = (fx._c(base_hours) + team_penalty_hours(team)) + fx._c(target_hours).cast("double") * F.lit(0.15)
    return x if digits is None else fx.round_half_even(x, digits)


def resolved_at(created_at, resolution_hours, status) -> Column:
    """created_at + the resolution time (to the second) for closed tickets, else null."""
    secs = F.round(fx._c(resolution_hours) * F.lit(3600.0), 0).cast("long")
    return F.when(fx._c(status).isin(*K.CLOSED_TICKET_STATUSES), fx.add_seconds(created_at, secs))


def enrich_resolved_at(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn("resolved_at", resolved_at("created_at", "resolution_time_hours", "status"))


def risk_score(base, amount, account_age_days, digits: int | None = 1) -> Column:
    """clip(base + 12·[amount > 100000] + 15·[age < 30], 0, 100), rounded half to even."""
    x = fx.clip(
        fx._c(base)
        + F.when(fx._c(amount) > F.lit(float(K.HIGH_AMOUNT)), F.lit(float(K.HIGH_AMOUNT_RISK))).otherwise(F.lit(0.0))
        + F.when(fx._c(account_age_days) < F.lit(K.NEW_ACCOUNT_DAYS), F.lit(float(K.NEW_ACCOUNT_RISK)))
        .otherwise(F.lit(0.0)),
        0.0, 100.0)
    return x if digits is None else fx.round_half_even(x, digits)


def is_night(ts) -> Column:
    lo, hi = K.NIGHT_HOURS
    return F.hour(fx._c(ts)).between(lo, hi)


def expected_failure_bp(gateway, ts) -> Column:
    """Expected failure probability of a transaction, in basis points (exact)."""
    base = F.when(fx._c(gateway) == F.lit("GatewayC"), F.lit(round(K.GATEWAY_C_FAILURE_PROB * 10000))) \
        .otherwise(F.lit(round(K.BASE_FAILURE_PROB * 10000)))
    return base + F.when(is_night(ts), F.lit(round(K.NIGHT_FAILURE_BOOST * 10000))).otherwise(F.lit(0))


def failure_expectation(txn: DataFrame) -> DataFrame:
    """Expected vs observed failure rate per gateway and night/day band."""
    agg = (txn.where(F.col("timestamp").isNotNull())
           .groupBy("gateway", is_night("timestamp").alias("night"))
           .agg(F.count(F.lit(1)).alias("txns"),
                F.sum(expected_failure_bp("gateway", "timestamp")).alias("_bp"),
                F.count_if(F.col("status") == "Failed").alias("_failed")))
    return agg.select(
        "gateway", "night", "txns",
        fx.ratio_half_up("_bp", F.col("txns") * F.lit(100), 100).alias("expected_rate_pct"),
        fx.rate_pct_2dp("_failed", "txns").alias("observed_rate_pct"),
    ).orderBy("gateway", "night")


def link_candidates(txn: DataFrame, n_tickets: int, seed: int = K.DASHBOARD_SAMPLE_SEED) -> DataFrame:
    """Up to ``n_tickets · 0.6`` failed or reversed transactions, an exact-size
    seeded sample (all of them when there are fewer)."""
    pool = txn.where(F.col("status").isin(*K.LINKABLE_TRANSACTION_STATUSES))
    return hash_sample(pool, "transaction_id", int(n_tickets * K.LINKED_TICKET_SHARE), seed)


def ticket_links(tickets: DataFrame) -> DataFrame:
    """Every ticket, labelled as linked to a transaction or not: the union of
    the linked and the unlinked rows, computed as one labelled pass (a
    UNION ALL of two filters would derive the tickets twice)."""
    kind = F.when(fx.non_empty("related_transaction_id"), F.lit("linked")).otherwise(F.lit("unlinked"))
    return tickets.select("ticket_id", "related_transaction_id", kind.alias("link_kind"))
