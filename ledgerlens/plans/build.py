"""Build path: derive the two operational tables once and store them.

The dashboard path then reads the stored tables (``load_tables``) instead of
re-deriving them for every query. Stored by calendar day, a date filter
prunes whole directories (``_date``) on top of Parquet row-group statistics.

A build is a snapshot (``sources.snapshots``): both tables and their cube
(``plans.cube``) appear together once all are written, and readers keep the
version that they opened. Counts and date ranges are taken while rows are
written (``Observation``) and kept in the manifest, so a build returns its audit
without another scan. ``replace_days`` brings in new rows day by day: only these
days are written, for the rows and for the cube.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as fx
from ..sources import io, snapshots
from ..sources.conform import conformed_tables
from ..sources.snapshots import Part, Snapshot
from . import cube

DATE_COLUMNS = {"transactions": "timestamp", "support_tickets": "created_at"}


def _stored(spark: SparkSession, root: str, df: DataFrame, table: str, by_day: bool) -> Part:
    """Write the rows of a table as a new part."""
    path = snapshots.new_part(spark, root)
    figures = io.write_table(df, f"{root}/{path}", DATE_COLUMNS[table] if by_day else None, io.ORDER_KEYS[table],
                             observe=DATE_COLUMNS[table])
    schema = df.withColumn("_date", F.to_date(DATE_COLUMNS[table])).schema if by_day else df.schema
    return Part(path, snapshots.days_of(spark, root, path) or (() if by_day else None), schema.json(), figures)


def write_states(spark: SparkSession, root: str, states: DataFrame) -> Part:
    """Write a state table of the cube as a new part, one file a day (states of a day are few)."""
    path = snapshots.new_part(spark, root)
    states.hint("rebalance", "_date").write.partitionBy("_date").parquet(f"{root}/{path}")
    return Part(path, snapshots.days_of(spark, root, path), states.schema.json())


def _states(spark: SparkSession, root: str, parts: dict[str, Part]) -> dict[str, Part]:
    """Write the states of rows that have just been written, read from there."""
    rows = {name: snapshots.read_part(spark, root, part) for name, part in parts.items()}
    found = cube.states_of(rows.get("transactions"), rows.get("support_tickets"))
    return {name: write_states(spark, root, df) for name, df in found.items()}


def _build(spark: SparkSession, tables: dict[str, DataFrame], table_dir: str, by_day: bool) -> DataFrame:
    root = table_dir.rstrip("/")
    base = snapshots.open_snapshot(spark, root)
    parts = {name: _stored(spark, root, df, name, by_day) for name, df in tables.items()}
    parts |= _states(spark, root, parts)
    return audit(snapshots.publish(spark, root, {k: [v] for k, v in parts.items()}, base))


def build_tables(spark: SparkSession, sf_dir: str, table_dir: str, by_day: bool = True) -> DataFrame:
    """Store transactions, support_tickets and their cube as a new version under
    ``table_dir`` and return the load audit of what was written."""
    txn, tickets = conformed_tables(spark, sf_dir)
    return _build(spark, {"transactions": txn, "support_tickets": tickets}, table_dir, by_day)


def build_from_csv(spark: SparkSession, csv_dir: str, table_dir: str, by_day: bool = True) -> DataFrame:
    """The CSV build step: ``transactions.csv`` and ``support_tickets.csv``
    (header, fixed schema) under ``csv_dir`` as a new version; returns the load audit."""
    return _build(spark, {name: io.read_csv(spark, f"{csv_dir}/{name}.csv", name) for name in DATE_COLUMNS}, table_dir, by_day)


def replace_days(spark: SparkSession, table_dir: str, transactions: DataFrame | None = None,
                 support_tickets: DataFrame | None = None) -> Snapshot:
    """A new version in which the days that the given rows have are theirs alone, in
    the rows and in the cube; other days are neither read nor written."""
    root = table_dir.rstrip("/")
    base = snapshots.open_snapshot(spark, root)
    given = {"transactions": transactions, "support_tickets": support_tickets}
    rows = {name: _stored(spark, root, df, name, True) for name, df in given.items() if df is not None}
    rows = {name: part for name, part in rows.items() if part.days}
    new = {}
    for name, part in {**rows, **_states(spark, root, rows)}.items():
        days = rows["transactions" if name in ("transactions", "transaction_states") else "support_tickets"].days
        new[name] = snapshots.replaced(base.tables[name], days, part)
    new["impact_states"] = []                # of links between any days: made anew by store_impact
    return snapshots.publish(spark, root, new, base)


def store_impact(spark: SparkSession, table_dir: str) -> Snapshot:
    """A new version of the stored tables with the impact states of its rows."""
    root = table_dir.rstrip("/")
    base = snapshots.open_snapshot(spark, root)
    states = cube.impact_states(base.read("transactions"), base.read("support_tickets"))
    return snapshots.publish(spark, root, {"impact_states": [write_states(spark, root, states)]}, base)


def audit(version: Snapshot) -> DataFrame:
    """(table, rows) of a version: from its manifest, or from the cube's counts where days have been replaced."""
    out = []
    for table, states in (("transactions", "transaction_states"), ("support_tickets", "ticket_states")):
        known = version.figures(table)
        rows = sum(f["rows"] for f in known) if known else version.read(states).agg(F.sum("n")).first()[0] or 0
        out.append((table, rows))
    return version.spark.createDataFrame(out, "table string, rows long")


def load_cube(spark: SparkSession, table_dir: str, version: int | None = None) -> cube.Cube:
    """The cube of a stored version, by default the last."""
    found = snapshots.open_snapshot(spark, table_dir, version)
    if found is None:
        raise ValueError(f"no build has been finished in {table_dir}")
    return cube.Cube(*(found.read(name) for name in cube.TABLES),
                     found.read("impact_states") if "impact_states" in found.tables else None)


def store_links(spark: SparkSession, txn: DataFrame, tickets: DataFrame, name: str, path: str, buckets: int) -> None:
    """Catalog tables ``<name>_transactions`` and ``<name>_tickets`` bucketed by transaction
    id, for the join of tickets with their transactions. Only tickets that name one are
    stored, so the many that do not fill no bucket."""
    io.write_bucketed(txn, f"{name}_transactions", f"{path}/transactions", "transaction_id", buckets)
    io.write_bucketed(tickets.where(fx.non_empty("related_transaction_id")), f"{name}_tickets", f"{path}/tickets",
                      "related_transaction_id", buckets)


def load_links(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, tickets that name one) as ``store_links`` has stored them."""
    return spark.table(f"{name}_transactions"), spark.table(f"{name}_tickets")


load_tables = io.load_stored
