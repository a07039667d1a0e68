"""Scalar column functions shared by the analyses.

All are built-in Spark expressions (JVM side, inside whole-stage codegen); no
Python runs per row. Rounding is done on exact integers wherever the inputs
allow it, so a result does not depend on the order in which partial sums were
merged, i.e. on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(a, b) -> Column:
    """Integral division of two integral columns (SQL ``a div b``), truncating."""
    return F.call_function("div", _c(a), _c(b))


def ratio_half_up(num, den, scale: int) -> Column:
    """``num/den`` rounded half up to ``1/scale``, from integers (num >= 0, den > 0).

    ``(2*scale*num + den) div (2*den) / scale`` — exact integer arithmetic in
    ``decimal(38,0)`` (no overflow for sums over 10^12 rows), one final
    division. Null when ``den`` is 0 or null.
    """
    num, den = _c(num).cast("decimal(38,0)"), _c(den).cast("decimal(38,0)")
    k = int_div(F.lit(2 * scale).cast("decimal(38,0)") * num + den, F.lit(2).cast("decimal(38,0)") * den)
    return F.when(den > 0, k / F.lit(float(scale)))


def rate_pct_2dp(num, den) -> Column:
    """``ROUND(100.0 * num / den, 2)`` for counts, computed exactly."""
    return ratio_half_up(F.lit(100).cast("decimal(38,0)") * _c(num).cast("decimal(38,0)"), den, 100)


# Hours are added up in millionths (3.6 ms), whole numbers, so that sums do not
# depend on their order.
UNITS = 1_000_000


def units(x) -> Column:
    """A quantity as a whole number of millionths."""
    return F.round(_c(x) * F.lit(float(UNITS)), 0).cast("long")


def mean_2dp_from_units(sum_units, n) -> Column:
    """Mean to 2 digits, from the exact sum of millionths."""
    return ratio_half_up(sum_units, _c(n).cast("decimal(38,0)") * F.lit(UNITS).cast("decimal(38,0)"), 100)


def mean_from_units(sum_units, n) -> Column:
    """Unrounded mean, from the exact sum of millionths."""
    return safe_div(sum_units, F.lit(float(UNITS)) * _c(n).cast("double"))


def safe_div(num, den) -> Column:
    """``num / den`` as doubles; null (not an error) when ``den`` is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def round_half_away(x, digits: int) -> Column:
    """Round a double half away from zero at ``digits`` (the SQL ``ROUND`` rule)."""
    p = float(10 ** digits)
    x = _c(x)
    r = F.floor(F.abs(x) * F.lit(p) + F.lit(0.5)) / F.lit(p)
    return F.when(x < 0, -r).otherwise(r)


def round_half_even(x, digits: int) -> Column:
    """numpy's ``round``: half to even on ``x * 10**digits`` as a double."""
    p = float(10 ** digits)
    return F.rint(_c(x) * F.lit(p)) / F.lit(p)


def pct(num, den) -> Column:
    """Unrounded ``100 * (num / den)`` as in a mean of a boolean times 100."""
    return F.lit(100.0) * safe_div(num, den)


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def flag(cond: Column) -> Column:
    """Boolean to the 0/1 integer flag the tables use."""
    return cond.cast("int")


def sql_literal(v) -> str:
    """A Python constant as a Spark SQL literal (doubles as ``D`` literals)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return repr(v) + "D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def pick(values: Sequence[str], index) -> Column:
    """``values[index mod len(values)]`` as a literal array lookup."""
    if isinstance(index, str):
        # One expression (parsed on the JVM side) instead of one call per literal.
        arr = ", ".join(sql_literal(v) for v in values)
        return F.expr(f"element_at(array({arr}), CAST(pmod(`{index}`, {len(values)}) + 1 AS INT))")
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(_c(index), F.lit(len(values))) + 1).cast("int"))


def lookup(mapping: dict, key, default=None) -> Column:
    """Key lookup in a small literal map; unmapped keys give ``default``."""
    if isinstance(key, str):
        branches = " ".join(f"WHEN `{key}` = {sql_literal(k)} THEN {sql_literal(v)}" for k, v in mapping.items())
        tail = "" if default is None else f" ELSE {sql_literal(default)}"
        return F.expr(f"CASE {branches}{tail} END")
    out = None
    for k, v in mapping.items():
        out = F.when(_c(key) == F.lit(k), F.lit(v)) if out is None else out.when(_c(key) == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def micros_between(start, end) -> Column:
    """Exact microseconds from ``start`` to ``end`` (naive timestamps, no zone)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


HOUR_MICROS = 3_600_000_000


def hours_between_2dp(start, end) -> Column:
    """Elapsed hours rounded half away from zero to 2 digits, exactly."""
    d = micros_between(start, end)
    k = int_div(F.lit(2) * F.abs(d) + F.lit(HOUR_MICROS // 100), F.lit(2 * HOUR_MICROS // 100))
    r = k / F.lit(100.0)
    return F.when(d < 0, -r).otherwise(r)


def add_hours(ts, hours) -> Column:
    return F.timestamp_add("HOUR", _c(hours), _c(ts))


def add_minutes(ts, minutes) -> Column:
    return F.timestamp_add("MINUTE", _c(minutes), _c(ts))


def add_seconds(ts, seconds) -> Column:
    return F.timestamp_add("SECOND", _c(seconds), _c(ts))


def prefixed_id(prefix: str, *parts) -> Column:
    """``prefix`` followed by the parts joined with '-' (e.g. TXN100042)."""
    body = F.concat_ws("-", *[_c(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), body)


def non_empty(x) -> Column:
    """SQL ``x <> ''``: false for '' and unknown (so filtered out) for NULL."""
    return _c(x) != F.lit("")
