"""Named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the star tables at ``sf_dir``, derives the operational
tables from them (``sources.conform``) and runs one analysis over the whole
tables. The DuckDB twin of each is in ``oracle_sql``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import anomaly as AN
from ..operators import enrich as EN
from ..operators.filters import ViewFilter, filter_domains, filter_tickets, filter_transactions
from ..operators.quantile import five_numbers
from ..operators.stats import with_minmax_norm, with_zscore_flags
from ..session import configured_checkpoint_dir, drop_materialized, ensure_checkpoint_dir, materialize, sf_path
from ..sources import io, snapshots
from ..sources.conform import (StarTables, conformed_tables, conformed_tickets, conformed_transactions,
                               risk_inputs, support_tickets, ticket_inputs, transactions)
from . import analyses as A
from . import cube
from . import dashboard as D
from .build import load_cube, load_links, store_links, write_states
from .oracle_sql import (ANOMALY_SETTINGS, AS_OF, DEMO_FILTER, LINK_SAMPLE_DIVISOR, analysis_sql, anomaly_sql,
                         cube_sql, dashboard_sql, enrich_sql, source_sql)

Query = Callable[[SparkSession, str], DataFrame]


def _txn(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(conformed_transactions(spark, sf_dir))
    return run


def _tk(fn, links: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(conformed_tickets(spark, sf_dir, links))
    return run


def _both(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        txn, tk = conformed_tables(spark, sf_dir)
        return fn(txn, tk)
    return run


def analysis_queries() -> dict[str, Query]:
    return {
        "gateway_health": _txn(A.gateway_health),
        "failure_reasons": _txn(A.failure_reasons),
        "daily_throughput": _txn(A.daily_throughput),
        "sla_by_priority_team": _tk(A.sla_by_priority_team, links=False),
        "agent_efficiency": _tk(A.agent_efficiency, links=False),
        "ticket_impact_by_reason": _both(lambda txn, tk: A.ticket_impact_by_reason(tk, txn)),
        "ticket_impact_bucketed": ticket_impact_bucketed,
        "sla_risk": _tk(lambda tk: A.sla_risk(tk, as_of=AS_OF)),
        "processing_time_outliers": _txn(A.processing_time_outliers),
        "regional_health": _txn(A.regional_health),
    }


def _view(fn, f: ViewFilter = ViewFilter()) -> Query:
    """``fn(filtered_txn, filtered_tickets)`` over the view filter ``f``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        txn, tk = conformed_tables(spark, sf_dir)
        return fn(filter_transactions(txn, f), filter_tickets(tk, txn, f))
    return run


def _dashboard_specs() -> dict:
    """name -> (fn(filtered_txn, filtered_tickets), view filter)."""
    demo, full = ViewFilter(**DEMO_FILTER), ViewFilter()
    return {
        "filtered_transactions": (lambda t, k: t, demo),
        "filtered_tickets": (lambda t, k: k, demo),
        "kpi_summary": (D.kpi_summary, full),
        "kpi_summary_filtered": (D.kpi_summary, demo),
        "daily_failure_trend": (lambda t, k: D.daily_failure_trend(t), full),
        "gateway_performance": (lambda t, k: D.gateway_performance(t), full),
        "top_failure_reasons": (lambda t, k: D.top_failure_reasons(t), full),
        "regional_ops": (lambda t, k: D.regional_ops(t), full),
        "sla_heatmap": (lambda t, k: D.sla_heatmap(k), full),
        "resolution_distribution": (lambda t, k: D.resolution_distribution(k), full),
        "csat_by_sla_outcome": (lambda t, k: D.csat_by_sla_outcome(k), full),
        "bottleneck_agents": (lambda t, k: D.bottleneck_agents(k), full),
    }


def dashboard_queries() -> dict[str, Query]:
    q = {name: _view(fn, f) for name, (fn, f) in _dashboard_specs().items()}
    q["filter_domains"] = _txn(filter_domains)
    return q


def dashboard_over(txn: DataFrame, tickets: DataFrame, reuse: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """The dashboard datasets over given (e.g. stored) tables. With ``reuse`` each
    filtered view is kept (memory, spilling to disk) for the datasets that
    share it; ``spark.catalog.clearCache()`` lets go of them."""
    views: dict[ViewFilter, tuple[DataFrame, DataFrame]] = {}

    def view(f: ViewFilter) -> tuple[DataFrame, DataFrame]:
        if f not in views:
            pair = filter_transactions(txn, f), filter_tickets(tickets, txn, f)
            views[f] = tuple(io.reuse(x) for x in pair) if reuse else pair
        return views[f]

    out = {name: (lambda fn=fn, f=f: fn(*view(f))) for name, (fn, f) in _dashboard_specs().items()}
    out["filter_domains"] = lambda: filter_domains(txn)
    return out


def stored_datasets(spark: SparkSession, table_dir: str, f: ViewFilter = ViewFilter()) -> dict[str, Callable[[], DataFrame]]:
    """The dashboard datasets of a stored build under a view filter: the additive
    ones from its cube, the two filtered tables from its rows, all of one version."""
    version = snapshots.open_snapshot(spark, table_dir)
    if version is None:
        return dashboard_over(*io.load_stored(spark, table_dir))
    states = load_cube(spark, table_dir, version.version)
    out = {name: (lambda name=name: getattr(states, name)(f)) for name in cube.DATASETS}
    txn, tickets = io.load_stored(spark, table_dir, version.version)
    return out | {"filtered_transactions": lambda: filter_transactions(txn, f),
                  "filtered_tickets": lambda: filter_tickets(tickets, txn, f)}


def _zscore_flags(txn: DataFrame) -> DataFrame:
    return with_zscore_flags(txn.select("transaction_id", "processing_time_ms", "amount"),
                             {"processing_time_ms": "pt_outlier", "amount": "amount_outlier"}, K.OUTLIER_Z).select(
        "transaction_id", "pt_outlier", "amount_outlier")


def _nine(column: str):
    """A score to nine digits, as the DuckDB twin is compared."""
    return F.round(column, 9).alias(column)


def _forest_scores(txn: DataFrame) -> DataFrame:
    return AN.transaction_forest(txn).scored(txn, K.DEFAULT_CONTAMINATION).select(
        "transaction_id", _nine("anomaly_score"), "is_anomaly")


def anomaly_queries() -> dict[str, Query]:
    return {
        "zscore_flags": _txn(_zscore_flags),
        "anomaly_reasons": _txn(lambda t: AN.with_reasons(t).select("transaction_id", "anomaly_reason")),
        "amount_minmax": _txn(lambda t: with_minmax_norm(t.select("transaction_id", "amount"), "amount", "norm_amount",
                                                         K.MINMAX_EPS).select("transaction_id", "norm_amount")),
        "amount_distribution": _txn(lambda t: five_numbers(t, "gateway", "amount")),
        "zscore_priority_anomalies": _txn(lambda t: AN.top_anomalies(
            AN.explain_and_rank(AN.zscore_scored(t)), K.DEFAULT_TOP_N)),
        "zscore_transaction_anomalies": _txn(lambda t: AN.explain_and_rank(AN.zscore_scored(t)).select(
            "transaction_id", "anomaly_score", "is_anomaly", "anomaly_reason", "priority_score")),
        "isolation_forest_scores": _txn(_forest_scores),
        "transaction_anomalies": _txn(lambda t: AN.detect_transaction_anomalies(t).select(
            "transaction_id", _nine("anomaly_score"), "is_anomaly", "anomaly_reason", "priority_score")),
        "top_priority_anomalies": _txn(AN.top_priority_anomalies),
        "sampled_anomaly_view": _view(lambda t, k: AN.sampled_anomaly_view(
            t, K.DEFAULT_CONTAMINATION, K.DASHBOARD_TOP_N)),
        **{name: _txn(lambda t, share=share, top=top: AN.top_priority_anomalies(t, top, share))
           for name, (share, top) in ANOMALY_SETTINGS.items()},
    }


def stored_cube(spark: SparkSession, sf_dir: str) -> cube.Cube:
    """The cube of the star tables, stored in the session's checkpoint folder once
    for each version (paths, sizes and times) of their files."""
    base = configured_checkpoint_dir(spark) or ensure_checkpoint_dir(spark)
    root = f"{base.rstrip('/')}/cubes/{io.files_version(spark, [sf_path(sf_dir, t) for t in StarTables.NAMES])}"
    found = snapshots.open_snapshot(spark, root)
    if found is None:
        # Both tables are derived once; all states, the tickets' links among them, read the columns stored here.
        star = StarTables.load(spark, sf_dir)
        txn = materialize(transactions(star, with_event_id=True).select("event_id", *cube.TRANSACTION_INPUTS), as_table=True)
        tickets = materialize(cube.ticket_inputs(support_tickets(star, txn)), as_table=True)
        states = {**cube.states_of(txn, tickets), "impact_states": cube.impact_states(txn, tickets)}
        found = snapshots.publish(spark, root, {name: [write_states(spark, root, df)] for name, df in states.items()})
        drop_materialized(tickets)
        drop_materialized(txn)
    return cube.Cube(*(found.read(name) for name in (*cube.TABLES, "impact_states")))


def ticket_impact_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticket_impact_by_reason`` over tables stored by transaction id, in the session's
    checkpoint folder, once for each version of the star tables."""
    base = configured_checkpoint_dir(spark) or ensure_checkpoint_dir(spark)
    name = f"links_{io.files_version(spark, [sf_path(sf_dir, t) for t in StarTables.NAMES])}"
    if not spark.catalog.tableExists(f"{name}_tickets"):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        store_links(spark, *conformed_tables(spark, sf_dir), name, f"{base.rstrip('/')}/links/{uuid.uuid4().hex}", buckets)
    txn, tickets = load_links(spark, name)
    return A.ticket_impact_by_reason(tickets, txn)


def cube_queries() -> dict[str, Query]:
    """The datasets under a view filter, from the stored cube: no row is read."""
    f = ViewFilter(**DEMO_FILTER)
    return {f"cube_{name}": (lambda spark, sf_dir, name=name: getattr(stored_cube(spark, sf_dir), name)(f))
            for name in (*cube.DATASETS, "ticket_impact_by_reason")}


def _star(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(StarTables.load(spark, sf_dir))
    return run


def _link_candidates(t: StarTables, divisor: int) -> DataFrame:
    """Link candidates for as many tickets as there are (line items with an order
    and a supplier), or a fraction of them."""
    n = (t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").count())
    return EN.link_candidates(transactions(t), n // divisor).select("transaction_id", "timestamp", "customer_id", "status")


def enrich_queries() -> dict[str, Query]:
    return {
        "enrich_sla": _tk(lambda k: EN.enrich_sla(k.select("ticket_id", "priority", "resolution_time_hours"))
                          .select("ticket_id", "sla_target_hours", "sla_breached"), links=False),
        "enrich_resolution_time": _star(lambda t: ticket_inputs(t).select(
            "ticket_id", "agent_team",
            EN.resolution_time("base_hours", "agent_team", "sla_target_hours").alias("resolution_time_hours"))),
        "enrich_resolved_at": _tk(lambda k: EN.enrich_resolved_at(k).select("ticket_id", "resolved_at")),
        "enrich_risk_score": _star(lambda t: risk_inputs(t).select(
            "transaction_id",
            EN.risk_score("base_risk", "amount", "account_age_days").alias("risk_score"))),
        "failure_expectation": _txn(EN.failure_expectation),
        "link_candidates": _star(lambda t: _link_candidates(t, 1)),
        "link_candidates_sampled": _star(lambda t: _link_candidates(t, LINK_SAMPLE_DIVISOR)),
        "ticket_links": _tk(EN.ticket_links),
    }


def source_queries() -> dict[str, Query]:
    return {
        "load_audit": _both(io.load_audit),
        "preview_transactions": _txn(lambda t: io.preview(t, "transactions")),
        "preview_tickets": _tk(lambda k: io.preview(k, "support_tickets")),
    }


def all_queries() -> dict[str, Query]:
    q = {}
    for part in (analysis_queries, dashboard_queries, cube_queries, anomaly_queries, enrich_queries, source_queries):
        q.update(part())
    return q


def all_oracle_sql() -> dict[str, str]:
    q = {}
    for part in (analysis_sql, dashboard_sql, cube_sql, anomaly_sql, enrich_sql, source_sql):
        q.update(part())
    return q
