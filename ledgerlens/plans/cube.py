"""A cube of additive states behind the dashboard datasets.

Three small tables take the place of the rows:

- ``transaction_states`` by day, region, gateway, status and failure reason;
- ``ticket_states`` by day, region, priority, team, agent and SLA outcome;
- ``resolution_states`` by day, region, team and resolution time (in millionths),
  the frequencies from which exact quantiles are taken.

A fourth, ``impact_states``, keeps which tickets a failure reason has led to as
bitmaps of dense ticket numbers, which merge, so distinct counts are exact too.

Their size follows the number of combinations, not the number of rows. All
figures in them are counts and exact sums, so they add up over days and over any
choice of regions and gateways: every dataset but the two filtered tables
themselves is the same as over rows (``plans.dashboard``) and reads no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import core as fx
from ..operators.filters import ViewFilter, _and, _member, filter_domains
from ..operators.numbering import dense_numbers

TABLES = ("transaction_states", "ticket_states", "resolution_states")
# What the states and the links are taken from.
TRANSACTION_INPUTS = ("transaction_id", "timestamp", "region", "gateway", "status", "failure_reason", "processing_time_ms",
                      "is_fraud_flag")
TICKET_INPUTS = ("ticket_id", "created_at", "related_transaction_id", "region", "priority", "agent_team", "agent_id",
                 "sla_breached", "resolution_time_hours", "csat_score")


def ticket_inputs(tickets: DataFrame) -> DataFrame:
    """The columns of tickets that the states read. Of a ticket without a link only
    whether it has an id matters, so its id is stored as an empty text."""
    known = F.when(fx.non_empty("related_transaction_id") | F.col("ticket_id").isNull(), F.col("ticket_id")).otherwise(F.lit(""))
    return tickets.select(*TICKET_INPUTS).withColumn("ticket_id", known)


def transaction_states(txn: DataFrame) -> DataFrame:
    return txn.groupBy(F.to_date("timestamp").alias("_date"), "region", "gateway", "status", "failure_reason").agg(
        F.count(F.lit(1)).alias("n"), F.count("transaction_id").alias("ids"),
        F.sum("processing_time_ms").alias("pt_sum"), F.count("processing_time_ms").alias("pt_n"),
        F.sum("is_fraud_flag").alias("fraud"))


def ticket_states(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy(F.to_date("created_at").alias("_date"), "region", "priority", "agent_team", "agent_id",
                           "sla_breached").agg(
        F.count(F.lit(1)).alias("n"), F.count("ticket_id").alias("ids"),
        F.sum(fx.units("resolution_time_hours")).alias("res_sum"), F.count("resolution_time_hours").alias("res_n"),
        F.sum("csat_score").alias("csat_sum"), F.count("csat_score").alias("csat_n"))


def resolution_states(tickets: DataFrame) -> DataFrame:
    known = tickets.where(F.col("agent_team").isNotNull() & F.col("resolution_time_hours").isNotNull())
    return known.groupBy(F.to_date("created_at").alias("_date"), "region", "agent_team",
                         fx.units("resolution_time_hours").alias("units")).agg(F.count(F.lit(1)).alias("n"))


def impact_states(txn: DataFrame, tickets: DataFrame) -> DataFrame:
    """By day, region, failure reason of the linked transaction and bucket of ticket
    numbers: which tickets (a bitmap of 32,768 numbers) and the sums over their links.
    Tickets are numbered by day and region, so a group's numbers lie in few buckets."""
    linked = tickets.where(fx.non_empty("related_transaction_id")).select(
        "ticket_id", F.to_date("created_at").alias("_date"), "region", "related_transaction_id", "resolution_time_hours", "csat_score")
    reasons = txn.select(F.col("transaction_id").alias("related_transaction_id"), "failure_reason")
    rows = linked.join(dense_numbers(linked, "ticket_id", ["_date", "region"]), "ticket_id", "left").join(
        reasons, "related_transaction_id")
    return rows.groupBy("_date", "region", "failure_reason", F.bitmap_bucket_number("no").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("tickets"),
        F.sum(fx.units("resolution_time_hours")).alias("res_sum"), F.count("resolution_time_hours").alias("res_n"),
        F.sum("csat_score").alias("csat_sum"), F.count("csat_score").alias("csat_n"))


def states_of(txn: DataFrame | None, tickets: DataFrame | None) -> dict[str, DataFrame]:
    """The state tables of given rows."""
    out = {}
    if txn is not None:
        out["transaction_states"] = transaction_states(txn)
    if tickets is not None:
        out |= {"ticket_states": ticket_states(tickets), "resolution_states": resolution_states(tickets)}
    return out


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))), F.lit(0))


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


@dataclass
class Cube:
    """The datasets under any view filter, from state tables alone."""
    transaction_states: DataFrame
    ticket_states: DataFrame
    resolution_states: DataFrame
    impact_states: DataFrame | None = None

    def _range(self, f: ViewFilter) -> Column:
        day = F.col("_date")
        if f.has_dates:
            return day.between(F.lit(str(f.start)).cast("date"), F.lit(str(f.end)).cast("date"))
        bounds = self.transaction_states.agg(F.struct(F.min("_date").alias("lo"), F.max("_date").alias("hi")).alias("b")).scalar()
        return day.between(bounds.getField("lo"), bounds.getField("hi"))

    def _txn(self, f: ViewFilter) -> DataFrame:
        if not f.has_dates and f.regions is None and f.gateways is None:
            return self.transaction_states.where(F.col("_date").isNotNull())
        return self.transaction_states.where(_and(self._range(f), _member("region", f.regions), _member("gateway", f.gateways)))

    def _tickets(self, f: ViewFilter, states: DataFrame | None = None) -> DataFrame:
        return (self.ticket_states if states is None else states).where(_and(self._range(f), _member("region", f.regions)))

    def filter_domains(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        """Of all rows, whatever the view."""
        return filter_domains(self.transaction_states.withColumn("timestamp", F.col("_date")))

    def kpi_summary(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        t = self._txn(f).agg(
            _total("n").alias("total_txns"), _count_if(F.col("status") == "Success").alias("_ok"),
            _count_if(F.col("status") == "Failed").alias("_failed"), F.sum("pt_sum").alias("_pt_sum"), _total("pt_n").alias("_pt_n"))
        k = self._tickets(f).agg(
            _total("n").alias("total_tickets"), F.sum(F.col("sla_breached") * F.col("n")).alias("_br"),
            _count_if(F.col("sla_breached").isNotNull()).alias("_br_n"), F.sum("res_sum").alias("_res"),
            _total("res_n").alias("_res_n"), F.sum("csat_sum").alias("_cs"), _total("csat_n").alias("_cs_n"))
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
            F.coalesce(fx.safe_div("_cs", "_cs_n"), zero).alias("avg_csat"))

    def daily_failure_trend(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        agg = self._txn(f).groupBy(F.col("_date").alias("date")).agg(
            F.sum("ids").alias("total"), _count_if(F.col("status") == "Failed").alias("failed"))
        rate = fx.safe_div(F.lit(100) * F.col("failed"), "total")
        return agg.select("date", "total", "failed", rate.alias("failure_rate_pct")).orderBy("date")

    def gateway_performance(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        agg = self._txn(f).where(F.col("gateway").isNotNull()).groupBy("gateway").agg(
            F.sum("ids").alias("total"), _count_if(F.col("status") == "Success").alias("_ok"), F.sum("n").alias("_n"),
            F.sum("pt_sum").alias("_pt_sum"), F.sum("pt_n").alias("_pt_n"))
        return agg.select("gateway", "total", fx.pct("_ok", "_n").alias("success_rate"),
                          fx.safe_div("_pt_sum", "_pt_n").alias("avg_proc")).orderBy("gateway")

    def top_failure_reasons(self, f: ViewFilter = ViewFilter(), top_n: int = 10) -> DataFrame:
        return (self._txn(f).where((F.col("status") == "Failed") & fx.non_empty("failure_reason"))
                .groupBy("failure_reason").agg(F.sum("n").alias("count"))
                .orderBy(F.desc("count"), "failure_reason").limit(top_n))

    def regional_ops(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        agg = self._txn(f).where(F.col("region").isNotNull()).groupBy("region").agg(
            F.sum("ids").alias("total"), _count_if(F.col("status") == "Success").alias("_ok"), F.sum("n").alias("_n"),
            F.sum("fraud").alias("fraud_flagged"))
        return agg.select("region", "total", fx.pct("_ok", "_n").alias("success_rate"), "fraud_flagged").orderBy("region")

    def sla_heatmap(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        agg = (self._tickets(f).where(F.col("priority").isNotNull() & F.col("agent_team").isNotNull())
               .groupBy("priority", "agent_team")
               .agg(F.sum("ids").alias("total"), F.sum(F.col("sla_breached") * F.col("n")).alias("_b"),
                    _count_if(F.col("sla_breached").isNotNull()).alias("_bn")))
        return agg.select("priority", "agent_team", "total", fx.pct("_b", "_bn").alias("breach_rate")).orderBy(
            "priority", "agent_team")

    def resolution_distribution(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        u = F.col("units")
        agg = self._tickets(f, self.resolution_states).groupBy("agent_team").agg(
            F.min(u).alias("_min"), F.percentile(u, [0.25, 0.5, 0.75], F.col("n")).alias("_q"), F.max(u).alias("_max"))
        h = F.lit(float(fx.UNITS))
        return agg.select("agent_team", (F.col("_min").cast("double") / h).alias("min"), (F.col("_q")[0] / h).alias("q1"),
                          (F.col("_q")[1] / h).alias("median"), (F.col("_q")[2] / h).alias("q3"),
                          (F.col("_max").cast("double") / h).alias("max")).orderBy("agent_team")

    def csat_by_sla_outcome(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        agg = (self._tickets(f).where(F.col("sla_breached").isNotNull()).groupBy("sla_breached")
               .agg(F.sum("csat_sum").alias("_s"), F.sum("csat_n").alias("_n")))
        return agg.orderBy("sla_breached").select(fx.lookup(K.SLA_OUTCOME_LABELS, "sla_breached").alias("sla_outcome"),
                                                  fx.safe_div("_s", "_n").alias("csat_score"))

    def bottleneck_agents(self, f: ViewFilter = ViewFilter(), min_tickets: int = K.AGENT_MIN_TICKETS, top_n: int = 10) -> DataFrame:
        agg = (self._tickets(f).where(F.col("agent_id").isNotNull() & F.col("agent_team").isNotNull())
               .groupBy("agent_id", "agent_team")
               .agg(F.sum("ids").alias("tickets"), F.sum("res_sum").alias("_rc"), F.sum("res_n").alias("_rn"),
                    F.sum(F.col("sla_breached") * F.col("n")).alias("breaches")))
        return (agg.where(F.col("tickets") >= min_tickets)
                .select("agent_id", "agent_team", "tickets", fx.mean_from_units("_rc", "_rn").alias("avg_resolution"), "breaches")
                .orderBy(F.desc("avg_resolution"), "agent_id", "agent_team").limit(top_n))


    def ticket_impact_by_reason(self, f: ViewFilter = ViewFilter()) -> DataFrame:
        """Distinct tickets from merged bitmaps, means from sums: the analysis over the view's tickets and all transactions."""
        if self.impact_states is None:
            raise ValueError("this version has no impact states; see build.store_impact")
        states = self.impact_states if f == ViewFilter() else self._tickets(f, self.impact_states)
        agg = states.groupBy("failure_reason", "bucket").agg(
            F.bitmap_count(F.bitmap_or_agg("tickets")).alias("n"), *(F.sum(c).alias(c) for c in ("res_sum", "res_n", "csat_sum", "csat_n")))
        agg = agg.groupBy("failure_reason").agg(F.sum("n").alias("tickets_generated"), *(
            F.sum(c).alias(c) for c in ("res_sum", "res_n", "csat_sum", "csat_n")))
        return agg.select(
            "failure_reason", "tickets_generated", fx.mean_2dp_from_units("res_sum", "res_n").alias("avg_resolution_hours"),
            fx.ratio_half_up("csat_sum", "csat_n", 100).alias("avg_csat")).orderBy(
            F.desc("tickets_generated"), F.asc_nulls_first("failure_reason"))


DATASETS = ("filter_domains", "kpi_summary", "daily_failure_trend", "gateway_performance", "top_failure_reasons", "regional_ops",
            "sla_heatmap", "resolution_distribution", "csat_by_sla_outcome", "bottleneck_agents")
