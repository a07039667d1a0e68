"""Conformed views: the driver's star-schema tables as the two operational tables.

``transactions`` is one row per event (events ⋈ orders ⋈ customer ⋈ nation ⋈
region) and ``support_tickets`` one row per line item (lineitem ⋈ orders ⋈
supplier ⋈ nation ⋈ region, left-joined to the failed/reversed transactions of
the same order). Both are plain DataFrame plans: Catalyst prunes the scans to
the columns used and the result has the fixed schemas of ``schemas``.

Join layout: the orderkey joins come first so that lineitem, orders and the
linked transactions share one hash partitioning on the order key (one shuffle
each); small sides (the nation ⋈ region dimension) are broadcast by Spark's
size-checked join selection, large ones are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import core as fx
from ..operators import enrich
from ..operators.joins import bounded_broadcast
from ..session import sf_path
from .schemas import SUPPORT_TICKETS, TICKET_COLUMNS, TRANSACTION_COLUMNS, TRANSACTIONS


class StarTables:
    """The driver's star tables, opened on first use (a query that needs only
    some of them does not list or open the others)."""

    NAMES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

    def __init__(self, spark: SparkSession | None = None, sf_dir: str | None = None, **frames: DataFrame):
        self._spark, self.source, self._frames = spark, sf_dir, dict(frames)

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str) -> "StarTables":
        return cls(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in StarTables.NAMES:
            raise AttributeError(name)
        frames = self.__dict__["_frames"]
        if name not in frames:
            frames[name] = self._spark.read.parquet(sf_path(self.source, name))
        return frames[name]


def region_of_nation(t: StarTables) -> DataFrame:
    """(nation key → region name): 25 rows, joined on a 25-value key, so it is
    broadcast (after a row-count check) rather than shuffle-joined."""
    dim = t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey).select(
        "n_nationkey", "r_name")
    return bounded_broadcast(dim)


def _txn_columns(e, o, with_event_id: bool) -> list:
    is_error = F.col("event_type") == F.lit("error")
    amount = (F.col("o_totalprice") * F.col("value")) / F.lit(1000.0)
    age = F.lit(1) + F.pmod(F.col("o_custkey") * F.lit(37), F.lit(3650))
    risk = enrich.risk_score(F.col("o_totalprice") / F.lit(6250.0), amount, age, digits=None)
    eid = F.col("event_id")
    status = (F.when(is_error, F.lit("Failed"))
              .when(F.pmod(eid, F.lit(50)) == 0, F.lit("Pending"))
              .when(F.pmod(eid, F.lit(67)) == 0, F.lit("Reversed"))
              .otherwise(F.lit("Success")))
    reason = (F.when(~is_error, F.lit(None).cast("string"))
              .when(F.pmod(eid, F.lit(41)) == 0, F.lit(""))
              .otherwise(fx.pick(K.FAILURE_REASONS, "event_id")))
    channel = fx.lookup({"1-URGENT": "UPI", "2-HIGH": "Card", "3-MEDIUM": "NetBanking",
                         "4-NOT SPECIFIED": "Wallet"}, "o_orderpriority", default="POS")
    retry = (F.when(is_error, F.pmod(F.col("o_custkey"), F.lit(5)))
             .when(F.pmod(eid, F.lit(97)) == 0, F.lit(1)).otherwise(F.lit(0)))
    cols = [
        F.concat(F.lit("TXN"), (F.lit(100000) + eid).cast("string")).alias("transaction_id"),
        F.col("ts").alias("timestamp"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        channel.alias("channel"),
        fx.pick(K.TRANSACTION_TYPES, "event_id").alias("transaction_type"),
        amount.alias("amount"),
        F.lit("INR").alias("currency"),
        status.alias("status"),
        reason.alias("failure_reason"),
        (F.lit(50) + F.floor(F.col("value") * F.lit(20.0))).cast("int").alias("processing_time_ms"),
        fx.pick(K.GATEWAYS, "user_id").alias("gateway"),
        F.col("r_name").alias("region"),
        fx.pick(K.DEVICE_TYPES, "event_id").alias("device_type"),
        retry.cast("int").alias("retry_count"),
        fx.flag((risk > F.lit(70.0)) & (F.pmod(eid, F.lit(5)) < 2)).alias("is_fraud_flag"),
        fx.pick(K.MERCHANT_CATEGORIES, "o_custkey").alias("merchant_category"),
        age.cast("int").alias("account_age_days"),
        risk.alias("risk_score"),
    ]
    if with_event_id:
        cols.append(eid.alias("event_id"))
    return cols


def transactions(t: StarTables, with_event_id: bool = False) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_nationkey")
    nr = region_of_nation(t)
    joined = (e.join(o, e.event_id == o.o_orderkey)
              .join(c, o.o_custkey == c.c_custkey)
              .join(nr, c.c_nationkey == nr.n_nationkey))
    df = joined.select(*_txn_columns(e, o, with_event_id))
    return df if with_event_id else df.select(*TRANSACTION_COLUMNS)


def ticket_priority(orderpriority) -> "F.Column":
    return fx.lookup({"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium"},
                     orderpriority, default="Low")


def ticket_team(partkey) -> "F.Column":
    """Team by ``partkey mod 100``: below 35, 55, 70, 90, else the last team."""
    if isinstance(partkey, str):
        t = [fx.sql_literal(v) for v in K.AGENT_TEAMS]
        b = f"pmod(`{partkey}`, 100)"
        return F.expr(f"CASE WHEN {b} < 35 THEN {t[0]} WHEN {b} < 55 THEN {t[1]} WHEN {b} < 70 THEN {t[2]} "
                      f"WHEN {b} < 90 THEN {t[3]} ELSE {t[4]} END")
    bucket = F.pmod(fx._c(partkey), F.lit(100))
    return (F.when(bucket < 35, F.lit(K.AGENT_TEAMS[0])).when(bucket < 55, F.lit(K.AGENT_TEAMS[1]))
            .when(bucket < 70, F.lit(K.AGENT_TEAMS[2])).when(bucket < 90, F.lit(K.AGENT_TEAMS[3]))
            .otherwise(F.lit(K.AGENT_TEAMS[4])))


def ticket_base_hours() -> "F.Column":
    """The base resolution effort of a line item, before team and SLA terms."""
    return F.col("l_quantity") * F.lit(0.25)


def ticket_id_column() -> "F.Column":
    return fx.prefixed_id("TCK", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def ticket_inputs(t: StarTables) -> DataFrame:
    """Per line item: ticket id, team, priority, SLA target and base hours,
    the inputs of the resolution-time rule."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    o = t.orders.select("o_orderkey", "o_orderpriority")
    pr = ticket_priority("o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        ticket_id_column().alias("ticket_id"), ticket_team("l_partkey").alias("agent_team"),
        pr.alias("priority"), enrich.sla_target_hours(pr).alias("sla_target_hours"),
        ticket_base_hours().alias("base_hours"))


def risk_inputs(t: StarTables) -> DataFrame:
    """Per event: transaction id, base risk, amount and account age, the
    inputs of the risk-score rule."""
    e = t.events.select("event_id", "value")
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return e.join(o, e.event_id == o.o_orderkey).select(
        F.concat(F.lit("TXN"), (F.lit(100000) + F.col("event_id")).cast("string")).alias("transaction_id"),
        (F.col("o_totalprice") / F.lit(6250.0)).alias("base_risk"),
        ((F.col("o_totalprice") * F.col("value")) / F.lit(1000.0)).alias("amount"),
        (F.lit(1) + F.pmod(F.col("o_custkey") * F.lit(37), F.lit(3650))).cast("int").alias("account_age_days"))


# What a ticket takes from its linked transaction.
LINK_COLUMNS = ["created_at", "related_transaction_id", "resolved_at"]


def support_tickets(t: StarTables, txn_with_event_id: DataFrame | None = None, links: bool = True) -> DataFrame:
    """The tickets; without ``links`` the columns of ``LINK_COLUMNS`` and the join
    they need are left out (the events have one row an ``event_id``, so the
    join adds no rows).

    Orders and linked transactions, both one row a key, are joined first, so the
    line items are shuffled by order key once and AQE can split a hot order.
    """
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_returnflag", "l_linestatus")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    nr = region_of_nation(t)
    supplier_region = s.join(nr, s.s_nationkey == nr.n_nationkey).select("s_suppkey", "r_name")
    if links:
        txn = txn_with_event_id if txn_with_event_id is not None else transactions(t, with_event_id=True)
        linked = (txn.where(F.col("status").isin(*K.LINKABLE_TRANSACTION_STATUSES))
                  .select(F.col("event_id").alias("t_event_id"),
                          F.col("transaction_id").alias("t_transaction_id"),
                          F.col("timestamp").alias("t_timestamp")))
        o = o.join(linked, o.o_orderkey == linked.t_event_id, "left")
    else:
        o = o.select("*", F.lit(None).cast("long").alias("t_event_id"), F.lit(None).cast("string").alias("t_transaction_id"),
                     F.lit(None).cast("timestamp_ntz").alias("t_timestamp"))
    joined = (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(supplier_region, li.l_suppkey == supplier_region.s_suppkey))

    is_linked = F.col("t_event_id").isNotNull()
    priority = ticket_priority("o_orderpriority")
    target = enrich.sla_target_hours(priority)
    pk = F.col("l_partkey")
    team = ticket_team("l_partkey")
    resolution = enrich.resolution_time(ticket_base_hours(), team, target, digits=None)
    breached = resolution > target
    ln3 = F.pmod(F.col("l_linenumber"), F.lit(3))
    status = F.expr("CASE WHEN l_returnflag = 'R' THEN 'Reopened' WHEN l_returnflag = 'A' THEN 'Resolved' "
                    "WHEN l_linestatus = 'F' THEN 'Closed' ELSE 'Pending' END")
    created = F.when(is_linked, fx.add_hours("t_timestamp", F.lit(1) + F.pmod(pk, F.lit(71)))).otherwise(
        fx.add_minutes(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
                       F.pmod(F.col("l_orderkey") * F.lit(13), F.lit(43200))))
    related = (F.when(is_linked, F.col("t_transaction_id"))
               .when(F.pmod(F.col("l_linenumber"), F.lit(2)) == 1, F.lit(""))
               .otherwise(F.lit(None).cast("string")))

    df = joined.select(
        ticket_id_column().alias("ticket_id"),
        created.alias("created_at"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        related.alias("related_transaction_id"),
        fx.pick(K.ISSUE_CATEGORIES, "l_partkey").alias("issue_category"),
        priority.alias("priority"),
        fx.pick(K.TICKET_CHANNELS, "l_suppkey").alias("channel"),
        F.col("r_name").alias("region"),
        target.cast("int").alias("sla_target_hours"),
        resolution.alias("resolution_time_hours"),
        fx.flag(breached).alias("sla_breached"),
        F.concat(F.lit("AGT"), (F.lit(1000) + F.pmod(pk * F.lit(7) + F.col("l_suppkey"), F.lit(600))).cast("string")
                 ).alias("agent_id"),
        team.alias("agent_team"),
        F.when(breached, F.lit(1) + ln3).otherwise(F.lit(3) + ln3).cast("int").alias("csat_score"),
        status.alias("status"),
        fx.flag(breached & (F.pmod(pk, F.lit(10)) < 3)).alias("escalation_flag"),
        F.when(status == "Reopened", F.lit(1) + ln3).otherwise(F.lit(0)).cast("int").alias("reopened_count"),
    )
    df = enrich.enrich_resolved_at(df).select(*TICKET_COLUMNS)
    return df if links else df.drop(*LINK_COLUMNS)


def conformed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, support_tickets) derived from the star tables at ``sf_dir``."""
    t = StarTables.load(spark, sf_dir)
    txn_e = transactions(t, with_event_id=True)
    return txn_e.select(*TRANSACTION_COLUMNS), support_tickets(t, txn_e)


def conformed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the transactions (no ticket plan is built)."""
    return transactions(StarTables.load(spark, sf_dir))


def conformed_tickets(spark: SparkSession, sf_dir: str, links: bool = True) -> DataFrame:
    """Only the support tickets (``links``: see ``support_tickets``)."""
    return support_tickets(StarTables.load(spark, sf_dir), links=links)


__all__ = ["StarTables", "transactions", "support_tickets", "conformed_tables",
           "TRANSACTIONS", "SUPPORT_TICKETS"]
