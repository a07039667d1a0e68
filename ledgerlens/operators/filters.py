"""View filters: date range, regions and gateways.

Date ranges are applied half-open on the raw timestamp
(``ts >= start AND ts < end + 1 day``), which equals "date between start and
end inclusive" and stays a plain comparison on the column, so Parquet
row-group statistics can skip data. An empty list selects nothing (as
``isin([])`` does); ``None`` means "no restriction".
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ViewFilter:
    start: dt.date | str | None = None
    end: dt.date | str | None = None
    regions: tuple[str, ...] | list[str] | None = field(default=None)
    gateways: tuple[str, ...] | list[str] | None = field(default=None)

    @property
    def has_dates(self) -> bool:
        # An incomplete pair falls back to the full range.
        return self.start is not None and self.end is not None


def _day_start(d) -> Column:
    return F.lit(str(d)).cast("date").cast("timestamp_ntz")


def domain_bounds(txn: DataFrame) -> tuple[Column, Column]:
    """First and last transaction date, as scalar subqueries (one pass)."""
    b = txn.agg(F.struct(F.min(F.to_date("timestamp")).alias("lo"),
                         F.max(F.to_date("timestamp")).alias("hi")).alias("b")).scalar()
    return b.getField("lo"), b.getField("hi")


def _date_range(ts: str, f: ViewFilter, txn: DataFrame, df: DataFrame | None = None) -> Column:
    if f.has_dates:
        lo, hi_next = _day_start(f.start), F.date_add(F.lit(str(f.end)).cast("date"), 1).cast("timestamp_ntz")
        cond = (F.col(ts) >= lo) & (F.col(ts) < hi_next)
        if df is not None and "_date" in df.columns:
            # Stored by day: the same range on the directory column prunes
            # whole partitions before any file is opened.
            cond = cond & F.col("_date").between(F.lit(str(f.start)).cast("date"), F.lit(str(f.end)).cast("date"))
        return cond
    lo_d, hi_d = domain_bounds(txn)
    lo, hi_next = lo_d.cast("timestamp_ntz"), F.date_add(hi_d, 1).cast("timestamp_ntz")
    return (F.col(ts) >= lo) & (F.col(ts) < hi_next)


def _member(col: str, values) -> Column | None:
    if values is None:
        return None
    values = list(values)
    return F.col(col).isin(values) if values else F.lit(False)


def _and(*conds) -> Column:
    out = None
    for c in conds:
        if c is not None:
            out = c if out is None else out & c
    return out if out is not None else F.lit(True)


def filter_transactions(txn: DataFrame, f: ViewFilter = ViewFilter()) -> DataFrame:
    if not f.has_dates and f.regions is None and f.gateways is None:
        # The default view is the full domain: every row with a timestamp.
        return txn.where(F.col("timestamp").isNotNull()).drop("_date")
    return txn.where(_and(_date_range("timestamp", f, txn, txn), _member("region", f.regions),
                          _member("gateway", f.gateways))).drop("_date")


def filter_tickets(tickets: DataFrame, txn: DataFrame, f: ViewFilter = ViewFilter()) -> DataFrame:
    """Tickets by creation date and region; no gateway predicate. The default
    date bounds are those of the transactions, so later tickets drop out."""
    return tickets.where(_and(_date_range("created_at", f, txn, tickets), _member("region", f.regions))).drop("_date")


def filter_domains(txn: DataFrame) -> DataFrame:
    """(kind, value): min_date, max_date, then the sorted distinct regions and gateways.

    One scan: a partial aggregate by (region, gateway) — a result the size of
    the domain — is exploded into (kind, key, date) entries and grouped once
    more, so min/max dates and the distinct values come out of the same pass.
    """
    dom = txn.groupBy("region", "gateway").agg(F.min(F.to_date("timestamp")).alias("lo"),
                                               F.max(F.to_date("timestamp")).alias("hi"))
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("date")

    def entry(order, kind, key, day):
        return F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), key.alias("key"), day.alias("d"))

    e = dom.select(F.explode(F.array(
        entry(0, "min_date", none_s, F.col("lo")), entry(1, "max_date", none_s, F.col("hi")),
        entry(2, "region", F.col("region"), none_d), entry(3, "gateway", F.col("gateway"), none_d))).alias("e")
    ).select("e.*")
    g = e.groupBy("ord", "kind", "key").agg(F.min("d").alias("mn"), F.max("d").alias("mx"))
    value = (F.when(F.col("ord") == 0, F.col("mn").cast("string"))
             .when(F.col("ord") == 1, F.col("mx").cast("string")).otherwise(F.col("key")))
    return (g.where((F.col("ord") < 2) | F.col("key").isNotNull())
            .select("ord", "kind", value.alias("value")).orderBy("ord", "value").drop("ord"))
