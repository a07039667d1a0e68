"""Anomaly explanation and prioritisation of transactions.

Given a frame with an anomaly score and flag, every row gets the tags that
explain it and a priority score; the flagged rows are ranked by priority.
The global statistics behind the tags and the min-max scaling are taken over
all rows passed in (before the anomaly filter), attached once as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import core as fx
from . import stats
from .forest_store import stored_forest
from .quantile import hash_sample

STATS = "_stats"


def _reason_stats() -> dict[str, Column]:
    return stats.moments("processing_time_ms", "pt_") | stats.moments("amount", "amount_")


def _reason_figures(st: Column) -> dict[str, Column]:
    return stats.figures_of(st, "pt_") | stats.figures_of(st, "amount_")


def _reasons(st: Column) -> Column:
    slow, unusual, retries, risky, failed = K.REASON_TAGS
    tags = [
        F.when(stats._flag(F.col("processing_time_ms"), st["pt_mean"], st["pt_std"], K.REASON_Z),
               F.lit(slow)),
        F.when(stats._flag(F.col("amount"), st["amount_mean"], st["amount_std"], K.REASON_Z),
               F.lit(unusual)),
        F.when(F.col("retry_count") >= K.HIGH_RETRIES, F.lit(retries)),
        F.when(F.col("risk_score") > K.HIGH_RISK_SCORE, F.lit(risky)),
        F.when(F.col("status") == "Failed", F.lit(failed)),
    ]
    joined = F.concat_ws(", ", *tags)     # skips the nulls of tags that do not apply
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(K.DEFAULT_REASON))


def with_reasons(df: DataFrame) -> DataFrame:
    """``df`` with ``anomaly_reason``: comma-separated tags in a fixed order, or
    the default text when none applies."""
    return stats.with_stats(df, STATS, _reason_figures, **_reason_stats()).select(
        *df.columns, _reasons(F.col(STATS)).alias("anomaly_reason"))


def explain_and_rank(scored: DataFrame, score_col: str = "anomaly_score", score_range: tuple | None = None) -> DataFrame:
    """Adds ``anomaly_reason`` and ``priority_score`` =
    round((0.55·norm score + 0.30·norm amount + 0.15·fraud flag)·100, 2), half to
    even, to every row; all statistics come from one aggregate over all rows.
    With ``score_range``, the known least and largest score, that aggregate reads no score."""
    lo, hi = (F.lit(float(v)) for v in score_range) if score_range else (F.min(score_col), F.max(score_col))
    ranges = lambda st: {k: st[k] for k in ("lo", "hi", "lo_amount", "hi_amount")}
    rows = stats.with_stats(scored, STATS, lambda st: _reason_figures(st) | ranges(st), **_reason_stats(), lo=lo, hi=hi,
                            lo_amount=F.min("amount"), hi_amount=F.max("amount"))
    st = F.col(STATS)
    norm = lambda c, lo, hi: (F.col(c) - st[lo]) / (st[hi] - st[lo] + F.lit(K.MINMAX_EPS))
    w_score, w_amount, w_fraud = K.PRIORITY_WEIGHTS
    blend = (F.lit(w_score) * norm(score_col, "lo", "hi") + F.lit(w_amount) * norm("amount", "lo_amount", "hi_amount")
             + F.lit(w_fraud) * F.col("is_fraud_flag")) * F.lit(100.0)
    return rows.select(*scored.columns, _reasons(st).alias("anomaly_reason"),
                       fx.round_half_even(blend, 2).alias("priority_score"))


def top_anomalies(ranked: DataFrame, top_n: int, flag_col: str = "is_anomaly") -> DataFrame:
    return (ranked.where(F.col(flag_col)).select(*K.ANOMALY_COLUMNS)
            .orderBy(F.desc("priority_score"), "transaction_id").limit(top_n))


def transaction_forest(txn: DataFrame, n_trees: int = K.FOREST_TREES, seed: int = K.FOREST_SEED):
    return stored_forest(txn, "transaction_id", K.FEATURES, n_trees, K.FOREST_MAX_SAMPLES, seed)


def detect_transaction_anomalies(txn: DataFrame, contamination: float = K.DEFAULT_CONTAMINATION,
                                 n_trees: int = K.FOREST_TREES, seed: int = K.FOREST_SEED) -> DataFrame:
    """All rows with ``anomaly_score``, ``is_anomaly``, ``anomaly_reason``, ``priority_score``.
    Rows are scored once, where they are read; the cut-off and the scores' range are the stored forest's."""
    forest = transaction_forest(txn, n_trees, seed)
    return explain_and_rank(forest.scored(txn, contamination), score_range=forest.anomaly_range(contamination))


def top_priority_anomalies(txn: DataFrame, top_n: int = K.DEFAULT_TOP_N,
                           contamination: float = K.DEFAULT_CONTAMINATION) -> DataFrame:
    return top_anomalies(detect_transaction_anomalies(txn, contamination), top_n)


def sampled_anomaly_view(ftxn: DataFrame, contamination: float = K.DEFAULT_CONTAMINATION,
                         top_n: int = K.DASHBOARD_TOP_N, max_rows: int | None = None,
                         seed: int = K.DASHBOARD_SAMPLE_SEED) -> DataFrame:
    """The dashboard's anomaly table. ``max_rows`` (off by default) scores an
    exact-size seeded sample instead of the whole view."""
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    src = ftxn if max_rows is None else hash_sample(ftxn, "transaction_id", max_rows, seed)
    return top_priority_anomalies(src, top_n, contamination)


def zscore_scored(txn: DataFrame, threshold: float = K.OUTLIER_Z) -> DataFrame:
    """A deterministic stand-in for the forest: the anomaly score is the
    absolute population z-score of processing time, flagged beyond
    ``threshold``. It drives the same explanation and ranking stages."""
    rows, z = stats.with_population_z(txn, "processing_time_ms")
    return rows.select(*txn.columns, F.abs(z.z).alias("anomaly_score"),
                       F.coalesce(z.beyond(threshold), F.lit(False)).alias("is_anomaly"))
