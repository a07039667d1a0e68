"""Exact order statistics of a column, without sorting it in one place.

``percentile`` keeps one counter per distinct value, and a global sort puts
every row through a range exchange; neither suits a high-cardinality column
of a very large table. Here the k-th smallest value is found by successive
histograms: each pass buckets the remaining candidates into ``bins`` buckets
between their min and max (one scan with a map-side partial aggregate, at
most ``bins`` rows reach the driver), keeps the bucket that holds rank k, and
stops when that bucket is a single value. The bucket index is a monotone
function of the value, so the ranks are exact; every size takes this path.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _bucket(v: Column, lo, hi, bins: int, integral: bool) -> Column:
    if integral:
        d = v.cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")
        width = F.lit(Decimal(int(hi) - int(lo) + 1)).cast("decimal(38,0)")
        return F.floor(d * F.lit(bins) / width).cast("int")
    # The middle bucket border always parts lo from hi, however near they are.
    mid = (float(lo) + float(hi)) / 2
    mid = mid if lo < mid <= hi else float(hi)
    frac = (v - F.lit(float(lo))) / (F.lit(float(hi)) - F.lit(float(lo)))
    place = F.floor(frac * F.lit(float(bins))).cast("int")
    half = bins // 2
    return (F.when(v < F.lit(mid), F.least(place, F.lit(half - 1)))
            .otherwise(F.greatest(F.lit(half), F.least(place, F.lit(bins - 1)))))


def select_ranks(df: DataFrame, column: str, ranks: Iterable[int], bins: int = 2048,
                 known: tuple | None = None) -> dict[int, object]:
    """Values at the given 0-based ranks of ``column`` in ascending order
    (nulls and NaN left out). Raises if a rank is out of range. ``known``: the
    number of values, the least and the largest, where the caller has them."""
    field = df.schema[column].dataType
    integral = isinstance(field, _INTEGRAL)
    v = F.col(column)
    keep = v.isNotNull() if integral else (v.isNotNull() & ~F.isnan(v))
    base = df.select(v.alias("v")).where(keep)
    n, lo0, hi0 = known or base.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    want = sorted(set(int(r) for r in ranks))
    if want and (want[0] < 0 or want[-1] >= n):
        raise ValueError(f"rank out of range for {n} values: {want}")
    out: dict[int, object] = {}
    below0 = 0
    if not integral and want and (math.isinf(lo0) or math.isinf(hi0)):
        # Infinities sit at the ends of the order: ranks inside those blocks
        # are answered directly, the histogram runs over the finite values.
        inf = base.agg(F.count_if(F.col("v") == F.lit(float("-inf"))).alias("neg"),
                       F.count_if(F.col("v") == F.lit(float("inf"))).alias("pos"),
                       F.min(F.when(~F.col("v").isin(float("inf"), float("-inf")), F.col("v"))).alias("lo"),
                       F.max(F.when(~F.col("v").isin(float("inf"), float("-inf")), F.col("v"))).alias("hi")).first()
        out.update({r: float("-inf") for r in want if r < inf["neg"]})
        out.update({r: float("inf") for r in want if r >= n - inf["pos"]})
        want = [r for r in want if inf["neg"] <= r < n - inf["pos"]]
        lo0, hi0, below0 = inf["lo"], inf["hi"], inf["neg"]
    # The bucket function is monotone, so a bucket is exactly the value range
    # between its min and max: each level's candidates are "v BETWEEN lo AND
    # hi", a predicate a Parquet scan can use to skip row groups.
    work = [(below0, lo0, hi0, want)] if want else []
    while work:
        below, lo, hi, rs = work.pop()
        if lo == hi:
            out.update({r: lo for r in rs})
            continue
        cand = base.where(F.col("v").between(F.lit(lo), F.lit(hi)))
        b = _bucket(F.col("v"), lo, hi, bins, integral)
        hist = sorted(cand.groupBy(b.alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(),
            key=lambda r: r["b"])
        start = below
        i = 0
        for h in hist:
            end = start + h["c"]
            inside = [r for r in rs[i:] if r < end]
            if inside:
                work.append((start, h["lo"], h["hi"], inside))
                i += len(inside)
            start = end
    return out


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation between neighbouring order statistics."""
    diff = b - a
    return b - diff * (1 - t) if t >= 0.5 else a + diff * t


def exact_percentile(df: DataFrame, column: str, q: float, n: int | None = None, **kw) -> float | None:
    """The ``q``-quantile (0..1) with linear interpolation, as ``numpy.percentile``;
    None without values. ``n``, if given, is the number of values."""
    if n is None:
        c = F.col(column)
        n = df.where(c.isNotNull() & ~F.isnan(c)).count()
    if n == 0:
        return None
    pos = q * (n - 1)
    k = int(math.floor(pos))
    k1 = min(k + 1, n - 1)
    vals = select_ranks(df, column, [k, k1], **kw)
    return _lerp(float(vals[k]), float(vals[k1]), pos - k)


def grouped_quantiles(df: DataFrame, key: str, column: str, qs: list[float], bins: int = 2048) -> DataFrame:
    """(key, n, lo, hi, quantiles): for every group the exact ``qs`` quantiles of a
    column of doubles, with linear interpolation, for all groups and ranks at once.

    A round is one scan: every group holds the disjoint value ranges that still hide
    one of its ranks, each range is counted in ``bins`` buckets (partial sums
    map-side), and the bucket with the rank becomes the next range, until ranges are
    single values. State between rounds is a row a group with a range a rank, kept
    as a table; what is shuffled is bounded by groups x ranks x bins, and no group's
    values come together. Null keys, and values that are null or NaN, take no part.
    """
    v = F.col(column).cast("double")
    base = df.select(F.col(key).alias("k"), v.alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    head = materialize(base.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")),
                       as_table=True)
    place = F.array(*(F.lit(float(q)) * (F.col("n") - 1) for q in qs))
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda p: F.array(
        F.floor(p), F.least(F.floor(p) + 1, F.col("n") - 1)))))
    # Infinities are moved to the ends of the range of doubles, so that ranges have a middle.
    most = F.lit(1.7976931348623157e308)
    inner = lambda x: F.greatest(-most, F.least(most, x))
    state = head.select("k", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), inner(F.col("lo")).alias("lo"),
                        inner(F.col("hi")).alias("hi"))
    while True:
        state = materialize(state, as_table=True)
        if state.where("lo < hi").isEmpty():
            break
        open_ranges = state.where("lo < hi").groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
        values = base.select("k", inner(F.col("v")).alias("v")).join(open_ranges, "k")
        values = values.select("k", "v", F.explode(F.filter("ranges", lambda r: F.col("v").between(r["lo"], r["hi"]))).alias("r"))
        lo, hi, x = F.col("r.lo"), F.col("r.hi"), F.col("v")
        # Halved before they are subtracted, so that no difference overflows; the middle always parts lo from hi.
        half = lambda c: c * F.lit(0.5)
        mid = F.when((half(lo) + half(hi) > lo) & (half(lo) + half(hi) <= hi), half(lo) + half(hi)).otherwise(hi)
        at = F.floor(F.coalesce(F.try_divide(half(x) - half(lo), half(hi) - half(lo)), F.lit(0.0)) * F.lit(float(bins)))
        bucket = F.when(x < mid, F.least(at, F.lit(bins // 2 - 1))).otherwise(
            F.greatest(F.lit(bins // 2), F.least(at, F.lit(bins - 1)))).cast("int")
        counts = values.groupBy("k", lo.alias("lo"), hi.alias("hi"), bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("b_lo"), F.max("v").alias("b_hi"))
        # Buckets of one range of one group: at most ``bins`` rows a window.
        before = F.sum("c").over(Window.partitionBy("k", "lo", "hi").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
        narrowed = state.where("lo < hi").join(counts, ["k", "lo", "hi"]).where(
            (F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("c"))).select(
            "k", "rank", (F.col("below") + F.col("before")).alias("below"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))
        state = state.where("lo = hi").union(narrowed)
    back = F.when(F.col("lo") == most, F.lit(float("inf"))).when(F.col("lo") == -most, F.lit(float("-inf"))).otherwise(F.col("lo"))
    found = state.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", back.alias("v")))).alias("at"))

    def between(q: float) -> Column:
        p = F.lit(float(q)) * (F.col("n") - 1)
        a, b = F.col("at")[F.floor(p)], F.col("at")[F.least(F.floor(p) + 1, F.col("n") - 1)]
        t = p - F.floor(p)
        # numpy's rule; a rank that is hit, and equal neighbours (also infinite ones), are themselves.
        return F.when((a == b) | (t == 0), a).when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)

    return head.join(found, "k").select(F.col("k").alias(key), "n", "lo", "hi", F.array(*map(between, qs)).alias("quantiles"))


def five_numbers(df: DataFrame, key: str, column: str) -> DataFrame:
    """Five-number summary of a column of any doubles by group, in order of the key."""
    q = F.col("quantiles")
    return grouped_quantiles(df, key, column, [0.25, 0.5, 0.75]).select(
        key, F.col("lo").alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        F.col("hi").alias("max")).orderBy(key)


def sample_hash(key, seed: int) -> Column:
    """A 60-bit hash of a key and a seed from md5, so that other engines can draw the same sample."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: str, n: int, seed: int, **kw) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by the smallest ``sample_hash(key, seed)``,
    of equal hashes by the key. Repeatable and independent of partitioning: the
    cut-off hash is found by rank selection, whatever the sizes."""
    hashed = df.withColumn("_h", F.coalesce(sample_hash(key, seed), F.lit(-1)))
    total = hashed.count()
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    cut = select_ranks(hashed, "_h", [n - 1], **kw)[n - 1]
    below = hashed.where(F.col("_h") < F.lit(cut))
    taken = below.count()
    at = hashed.where(F.col("_h") == F.lit(cut)).orderBy(key).limit(n - taken)
    return below.unionByName(at).drop("_h")
