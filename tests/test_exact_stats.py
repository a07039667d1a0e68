"""Statistics that do not depend on partitioning, and quantiles of all groups at once."""

import math
import random
import struct

import numpy as np
import pytest
from frames import txn_frame
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly, quantile, stats
from ledgerlens.plans import analyses


def bits(x):
    return None if x is None else struct.pack("<d", x)


def test_means_and_deviations_are_bit_equal_for_any_partitioning(spark):
    rng = random.Random(3)
    values = [rng.uniform(0, 1) * 10 ** rng.randint(-4, 9) for _ in range(3000)] + [0.1] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = set()
    for parts in (1, 8, 211):
        st = df.repartition(parts).orderBy(F.rand(parts)).agg(F.struct(*(e.alias(k) for k, e in stats.moments("x").items())).alias("s"))
        got = st.select(stats.mean_of(F.col("s")).alias("m"), stats.sample_std_of(F.col("s")).alias("d")).first()
        found.add((bits(got["m"]), bits(got["d"])))
    assert len(found) == 1
    assert math.isclose(got["m"], math.fsum(values) / len(values), rel_tol=1e-12)
    assert math.isclose(got["d"], np.std(values, ddof=1), rel_tol=1e-9)


@pytest.mark.parametrize("values,std", [([5.0], None), ([], None), ([None, 7.25, None], None), ([0.1] * 1000, 0.0),
                                        ([1e12 + 1, 1e12 + 2, 1e12 + 3], 1.0), ([float("nan"), float("inf"), 1.0, 3.0], math.sqrt(2))])
def test_edges(spark, values, std):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.agg(F.struct(*(e.alias(k) for k, e in stats.moments("x").items())).alias("s")).select(
        stats.mean_of(F.col("s")).alias("m"), stats.sample_std_of(F.col("s")).alias("d")).first()
    finite = [v for v in values if v is not None and math.isfinite(v)]
    assert got["m"] == (sum(finite) / len(finite) if finite else None)
    assert got["d"] == std if std is None else math.isclose(got["d"], std, rel_tol=1e-9, abs_tol=1e-12)


def test_sums_beyond_38_digits_are_taken_in_doubles(spark):
    df = spark.range(0, 4000).select((F.lit(9.0e11) + F.col("id") * 1e8).alias("x"))
    got = df.agg(F.struct(*(e.alias(k) for k, e in stats.moments("x").items())).alias("s")).select(
        stats.sample_std_of(F.col("s")).alias("d")).first()["d"]
    assert math.isclose(got, np.std(9.0e11 + np.arange(4000) * 1e8, ddof=1), rel_tol=1e-6)


def test_daily_means_are_bit_equal_for_any_partitioning(spark):
    rng = random.Random(8)
    txn = txn_frame(spark, [{"amount": rng.uniform(1, 9e5)} for _ in range(700)] + [{"amount": None}])
    got = {tuple(bits(r["avg_txn_amount"]) for r in analyses.daily_throughput(txn.repartition(p)).collect()) for p in (1, 8, 211)}
    assert len(got) == 1


def test_no_mean_of_raw_doubles_is_left():
    import inspect
    for module in (analyses, stats, anomaly):
        assert "F.avg(" not in inspect.getsource(module) and "stddev" not in inspect.getsource(module)


def test_flags_of_several_columns_equal_single_ones(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.gauss(0, 1) if i else 50.0, rng.choice([1, 2, None])) for i in range(400)], "i int, a double, b int")
    both = stats.with_zscore_flags(df, {"a": "fa", "b": "fb"})
    want = df.select("i", stats.zscore_flags(df, "a").alias("fa"), stats.zscore_flags(df, "b").alias("fb"))
    assert sorted(both.select("i", "fa", "fb").collect()) == sorted(want.collect())
    assert both.where("fa").count() == 1
    scaled = stats.with_minmax_norm(df, "a", "n").select("i", "n")
    assert sorted(scaled.collect()) == sorted(df.select("i", stats.minmax_norm(df, "a").alias("n")).collect())


def grouped(rows):
    out = {}
    for k, v in rows:
        if k is not None and v is not None and not math.isnan(v):
            out.setdefault(k, []).append(v)
    return out


@pytest.mark.parametrize("bins", [16, 2048])
def test_grouped_quantiles_equal_numpy(spark, bins):
    rng, inf = random.Random(9), float("inf")
    rows = [("hot", rng.uniform(-1, 1) * 10 ** rng.randint(-8, 8)) for _ in range(3000)]
    rows += [(f"g{i % 40}", rng.gauss(0, 1)) for i in range(2000)] + [("ties", rng.choice([1.0, 2.0, 2.5])) for _ in range(500)]
    rows += [("one", 3.5), ("two", 1.0), ("two", 2.0), ("null", None), (None, 1.0), ("nan", float("nan")), ("nan", 4.0)]
    rows += [("ends", v) for v in (inf, inf, -inf, 1.0, 2.0, 3.0, 1.7e308, -1.7e308, 5e-324, 0.0)] + [("all", inf)] * 3
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r for r in quantile.grouped_quantiles(df, "k", "v", qs, bins=bins).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for k, vs in want.items():
        assert (got[k]["n"], got[k]["lo"], got[k]["hi"]) == (len(vs), min(vs), max(vs))
        for q, x in zip(qs, got[k]["quantiles"]):
            pos = q * (len(vs) - 1)
            a, b = sorted(vs)[math.floor(pos)], sorted(vs)[min(math.floor(pos) + 1, len(vs) - 1)]
            want_x = a if a == b or pos == math.floor(pos) else quantile._lerp(a, b, pos - math.floor(pos))
            assert x == want_x or (math.isnan(x) and math.isnan(want_x)), (k, q)


def test_grouped_quantiles_of_nothing(spark):
    assert quantile.five_numbers(spark.createDataFrame([], "k string, v double"), "k", "v").collect() == []


def test_state_is_bounded_by_groups_and_bins(spark, monkeypatch):
    """No table between rounds has a row for every value."""
    sizes = []
    keep = quantile.materialize
    monkeypatch.setattr(quantile, "materialize", lambda df, as_table=False: (lambda out: (sizes.append(out.count()), out)[1])(keep(df, as_table)))
    df = spark.range(0, 200_000).select((F.col("id") % 3).cast("string").alias("k"), F.rand(5).alias("v"))
    quantile.five_numbers(df, "k", "v").collect()
    assert max(sizes) <= 3 * 6


def test_figures_are_derived_on_one_row(spark):
    """Means and deviations come from the one-row side; above the join no decimal arithmetic is left for every row."""
    from ledgerlens.operators import anomaly, stats

    df = spark.range(50).selectExpr("id as transaction_id", "cast(id as int) as processing_time_ms", "id * 1.5D as amount",
                                    "0 as retry_count", "1D as risk_score", "'Failed' as status")
    for out in (anomaly.with_reasons(df), stats.with_zscore_flags(df, {"processing_time_ms": "a", "amount": "b"})):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "decimal" not in plan.split("Join")[0].lower(), plan
