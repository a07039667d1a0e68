"""Global statistics joined back to every row without a join.

A global statistic (mean, standard deviation, min, max, a count) is an
aggregate with no keys: a partial aggregate per task and one tiny final
merge. It is attached to the rows as a *scalar subquery* (``DataFrame.scalar``),
which Spark evaluates once and inlines as a value; several statistics of the
same frame are merged into one aggregate by the optimizer. Where a statistic is
taken of a column that has statistics in it, it is attached as a one-row
broadcast side instead (``with_stats``). There is no window without a partition
(which would pull every row into one task).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXACT = "decimal(38,0)"


def scalar_of(df: DataFrame, expr: Column) -> Column:
    """``expr`` aggregated over all of ``df``, as a value usable on any row."""
    return df.agg(expr.alias("v")).scalar()


def scalars_of(df: DataFrame, **exprs: Column) -> dict[str, Column]:
    """Several aggregates of ``df`` in one scalar subquery (one struct value):
    one pass, one subquery, each field usable on any row."""
    s = df.agg(F.struct(*[e.alias(k) for k, e in exprs.items()]).alias("s")).scalar()
    return {k: s.getField(k) for k in exprs}


def with_stats(df: DataFrame, name: str, derived: Callable | None = None, **exprs: Column) -> DataFrame:
    """``df`` with one more column ``name``: a struct of aggregates over all of
    ``df``. It rides along as a one-row broadcast side, so a statistic of a
    column that itself needs statistics is planned once, not once a reference.
    ``derived`` makes the struct's fields of the aggregates' struct, on that one row."""
    one = df.agg(F.struct(*[e.alias(k) for k, e in exprs.items()]).alias(name))
    if derived:
        one = one.select(F.struct(*[e.alias(k) for k, e in derived(F.col(name)).items()]).alias(name))
    return df.crossJoin(F.broadcast(one))


@dataclass
class PopulationZ:
    """Population z-score of an integral column: with n rows, S1 = sum x and
    S2 = sum x*x (exact), z = (n x - S1) / sqrt(n S2 - S1^2), and |z| > k is
    |n x - S1| > k sqrt(n S2 - S1^2). There is no cancellation as
    E[x^2] - E[x]^2 would have at scale. A constant column gives z = null."""

    gap: Column
    root: Column

    @property
    def z(self) -> Column:
        return F.when(self.root > 0, self.gap / self.root)

    def beyond(self, k: float) -> Column:
        return (self.root > 0) & (F.abs(self.gap) > F.lit(float(k)) * self.root)


def with_population_z(df: DataFrame, column: str, name: str = "_moments") -> tuple[DataFrame, PopulationZ]:
    """``df`` with the moments of ``column`` attached once, and its z-score."""
    x = F.col(column).cast("long")
    n, s1 = F.count(column).cast(_EXACT), F.sum(x.cast("decimal(20,0)")).cast(_EXACT)
    s2 = F.sum((x * x).cast("decimal(20,0)")).cast(_EXACT)
    rows = with_stats(df, name, n=n.cast("double"), s1=s1.cast("double"), root=F.sqrt((n * s2 - s1 * s1).cast("double")))
    m = F.col(name)
    return rows, PopulationZ(m["n"] * x.cast("double") - m["s1"], m["root"])


def _flag(x: Column, mean: Column, std: Column, threshold: float) -> Column:
    z = (x - mean) / F.when(std > 0, std)
    return F.coalesce(F.abs(z) > F.lit(float(threshold)), F.lit(False))


# Moments are taken of whole millionths, so that sums do not depend on their order.
_UNITS = 1_000_000
_PART = 1_000_000_000


def moments(column: str, name: str = "") -> dict[str, Column]:
    """Aggregates of a column, named with a prefix: n, s1 (the exact sum in millionths)
    and the exact sum of squares in three parts, for millionths taken as a * 10**9 + b:
    s2a of a*a, s2b of a*b, s2c of b*b. Values that are no finite number are left
    out; values beyond 10**13 are an error."""
    x = F.col(column).cast("double")
    u = (F.when(F.abs(x) < F.lit(float("inf")), x).cast("decimal(19,6)") * F.lit(_UNITS)).cast("decimal(19,0)")
    a = F.call_function("div", u, F.lit(_PART).cast("decimal(10,0)")).cast("decimal(11,0)")
    b = (u - a * F.lit(_PART).cast("decimal(10,0)")).cast("decimal(10,0)")
    return {f"{name}{k}": e for k, e in (("n", F.count(u)), ("s1", F.sum(u)), ("s2a", F.sum(a * a)), ("s2b", F.sum(a * b)),
                                         ("s2c", F.sum(b * b)))}


def mean_of(st, name: str = "") -> Column:
    """The mean, from ``moments``."""
    return F.try_divide(st[f"{name}s1"].cast("double"), st[f"{name}n"].cast("double") * F.lit(float(_UNITS)))


def sample_std_of(st, name: str = "") -> Column:
    """The sample standard deviation, from ``moments``: n s2 - s1^2 is exact as far
    as 38 digits hold it, else taken in doubles; null for fewer than two values."""
    n, s1 = st[f"{name}n"], st[f"{name}s1"]
    parts = [(st[f"{name}s2a"], _PART * _PART), (st[f"{name}s2b"], 2 * _PART), (st[f"{name}s2c"], 1)]
    whole = lambda c: c.cast(_EXACT)
    s2 = None
    for value, factor in parts:
        term = F.try_multiply(whole(value), F.lit(factor).cast("decimal(19,0)"))
        s2 = term if s2 is None else F.try_add(s2, term)
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), s2), F.try_multiply(whole(s1), whole(s1))).cast("double")
    d = lambda c: c.cast("double")
    near = d(n) * sum((d(value) * F.lit(float(factor)) for value, factor in parts), F.lit(0.0)) - d(s1) * d(s1)
    pairs = d(n) * (d(n) - F.lit(1.0))
    return F.when(n > 1, F.sqrt(F.greatest(F.coalesce(exact, near), F.lit(0.0)) / pairs) / F.lit(float(_UNITS)))


def figures_of(st, name: str = "") -> dict[str, Column]:
    """The mean and the sample standard deviation, from ``moments``."""
    return {f"{name}mean": mean_of(st, name), f"{name}std": sample_std_of(st, name)}


def zscore_flags(df: DataFrame, column: str, threshold: float = 3.0) -> Column:
    """|x − mean| / sample-std > threshold, as a boolean column.

    All false when the standard deviation is 0 or undefined (one row, all
    null); a null value is false.
    """
    st = scalars_of(df, **moments(column))
    return _flag(F.col(column), mean_of(st), sample_std_of(st), threshold)


def with_zscore_flags(df: DataFrame, columns: dict[str, str], threshold: float = 3.0) -> DataFrame:
    """``df`` with a flag as ``zscore_flags`` gives for each of several columns
    (column -> name), all from one aggregate that is planned once."""
    wanted = {k: v for i, c in enumerate(columns) for k, v in moments(c, f"c{i}_").items()}
    figures = lambda st: {k: v for i in range(len(columns)) for k, v in figures_of(st, f"c{i}_").items()}
    rows, st = with_stats(df, "_stats", figures, **wanted), F.col("_stats")
    return rows.select(*df.columns, *(_flag(F.col(c), st[f"c{i}_mean"], st[f"c{i}_std"], threshold).alias(name)
                                      for i, (c, name) in enumerate(columns.items())))


def _scaled(x: Column, lo: Column, hi: Column, eps: float) -> Column:
    return (x - lo) / (hi - lo + F.lit(eps))


def minmax_norm(df: DataFrame, column: str, eps: float = 1e-9) -> Column:
    """(x − min) / (max − min + eps) with min and max over all of ``df``."""
    st = scalars_of(df, lo=F.min(column), hi=F.max(column))
    return _scaled(F.col(column), st["lo"], st["hi"], eps)


def with_minmax_norm(df: DataFrame, column: str, name: str, eps: float = 1e-9) -> DataFrame:
    """``df`` with a column as ``minmax_norm`` gives, the range planned once."""
    rows, st = with_stats(df, "_stats", lo=F.min(column), hi=F.max(column)), F.col("_stats")
    return rows.select(*df.columns, _scaled(F.col(column), st["lo"], st["hi"], eps).alias(name))
