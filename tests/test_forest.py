"""Isolation forest: planted outliers, contamination share, partition independence."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.operators import iforest
from ledgerlens.operators.quantile import exact_percentile, hash_sample, select_ranks

FEATURES = ["a", "b", "c"]


def _planted(spark, partitions):
    rng = np.random.default_rng(7)
    inl = rng.normal(0.0, 1.0, size=(2000, 3))
    out = rng.normal(12.0, 1.0, size=(20, 3))
    x = np.vstack([inl, out])
    rows = [(f"id{i:05d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id string, a double, b double, c double").repartition(partitions)


def test_planted_outliers_rank_first(spark):
    df = _planted(spark, 4)
    scored = iforest.isolation_forest_scores(df, "id", FEATURES, contamination=0.02, n_trees=50)
    pdf = scored.select("id", "anomaly_score", "is_anomaly").toPandas()
    flagged = set(pdf.loc[pdf.is_anomaly, "id"])
    planted = {f"id{i:05d}" for i in range(2000, 2020)}
    assert planted <= flagged
    assert abs(len(flagged) - 0.02 * len(pdf)) <= 2
    top = set(pdf.sort_values("anomaly_score", ascending=False).head(20)["id"])
    assert top == planted


def test_same_scores_for_1_and_8_partitions(spark):
    a = iforest.isolation_forest_scores(_planted(spark, 1), "id", FEATURES, n_trees=30).select("id", "anomaly_score")
    b = iforest.isolation_forest_scores(_planted(spark, 8), "id", FEATURES, n_trees=30).select("id", "anomaly_score")
    pa = a.toPandas().sort_values("id").reset_index(drop=True)
    pb = b.toPandas().sort_values("id").reset_index(drop=True)
    assert (pa["id"] == pb["id"]).all()
    assert np.allclose(pa["anomaly_score"], pb["anomaly_score"], rtol=0, atol=1e-12)


def test_select_ranks_with_ties(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=3000), np.full(3000, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    srt = np.sort(v)
    ranks = [0, 1, 2999, 3000, 4500, 5999]
    got = select_ranks(df, "v", ranks, bins=8)
    assert all(got[r] == srt[r] for r in ranks)
    assert exact_percentile(df, "v", 0.02) == np.percentile(v, 2.0)


def test_hash_sample_exact_and_repeatable(spark):
    df = spark.range(0, 5000).withColumn("k", F.concat(F.lit("k"), F.col("id").cast("string")))
    a = hash_sample(df, "k", 777, seed=1)
    b = hash_sample(df.repartition(7), "k", 777, seed=1)
    assert a.count() == 777
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())
    assert hash_sample(df, "k", 10**6, seed=1).count() == 5000


def test_vectorised_scoring_matches_tree_walk(spark):
    df = _planted(spark, 2)
    model = iforest.fit(df, "id", FEATURES, n_trees=12, max_samples=64, seed=5)
    x = np.array([r[1:] for r in df.select("id", *FEATURES).orderBy("id").limit(300).collect()], dtype=float)

    def path(row, root):
        node = root
        while model.feature[node] >= 0:
            f = model.feature[node]
            node = model.left[node] if row[f] <= model.threshold[node] else model.right[node]
        return model.path[node] / iforest.PATH_UNITS

    c = iforest.average_path_length([model.psi])[0]
    brute = np.array([-(2.0 ** (-np.mean([path(r, t) for t in model.roots]) / c)) for r in x])
    assert np.allclose(model.score_samples(x), brute, rtol=0, atol=1e-12)


def test_average_path_length():
    got = iforest.average_path_length([0, 1, 2, 3, 256])
    assert got[0] == 0 and got[1] == 0 and got[2] == 1
    assert abs(got[3] - (2 * (np.log(2) + iforest.EULER_GAMMA) - 4 / 3)) < 1e-12
    assert abs(got[4] - (2 * (np.log(255) + iforest.EULER_GAMMA) - 2 * 255 / 256)) < 1e-12


def test_integral_rank_selection(spark):
    df = spark.range(0, 20000).select((F.xxhash64("id") % 1000).alias("v"))
    srt = np.sort(np.array([r.v for r in df.collect()]))
    ranks = [0, 1, 9999, 19999]
    got = select_ranks(df, "v", ranks, bins=4)
    assert [got[r] for r in ranks] == [int(srt[r]) for r in ranks]


def test_hash_sample_takes_the_smallest_hashes(spark):
    from ledgerlens.operators.quantile import sample_hash
    df = spark.range(0, 4000).withColumn("k", F.concat(F.lit("k"), F.col("id").cast("string")))
    want = sorted((r.h, r.k) for r in df.select(sample_hash("k", 3).alias("h"), "k").collect())[:1500]
    assert sorted(r.k for r in hash_sample(df, "k", 1500, seed=3).collect()) == sorted(k for _, k in want)
    assert hash_sample(df, "k", 0, seed=3).count() == 0


def test_tree_samples_equal_brute_force(spark):
    """Exactly the psi smallest draws a tree, also when the first cut-off is too low."""
    trees, psi, seed = 7, 64, 11
    df = spark.range(0, 2000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.col("id").cast("double").alias("a"))
    x = iforest._features_frame(df, "id", ["a"], seed)
    rows = [(r._h, r._id) for r in x.collect()]
    want = {(t, i) for t in range(trees) for _, i in sorted((iforest.draw(h, t), i) for h, i in rows)[:psi]}
    for n in (2000, 200000):          # the second overstates n: the first cut-off is short
        sample, held = iforest._tree_samples(x, ["a"], n, psi, trees)
        got = [(r.tree_id, r._id) for r in sample.collect()]
        assert len(got) == trees * psi and set(got) == want
        held.unpersist()


def test_many_trees_on_many_rows(spark):
    df = spark.range(0, 300_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 997).cast("double").alias("a"))
    model = iforest.fit(df, "id", ["a"], n_trees=1000, max_samples=256, seed=3)
    assert len(model.roots) == 1000 and model.psi == 256


def test_a_model_beyond_the_bound_is_refused(spark):
    import pytest
    with pytest.raises(ValueError, match="nodes"):
        iforest.fit(spark.range(100_000).select(F.col("id").alias("id"), F.lit(1.0).alias("a")), "id", ["a"],
                    n_trees=1000, max_samples=50_000)


def test_views_of_no_one_and_two_rows(spark):
    from frames import txn_frame
    from ledgerlens.operators import anomaly
    rows = [{}, {"amount": 900.0, "processing_time_ms": 7000}]
    for n in (0, 1, 2):
        df = txn_frame(spark, rows).limit(n)
        out = anomaly.detect_transaction_anomalies(df).collect()
        assert len(out) == n and (n == 2 or not any(r["is_anomaly"] for r in out))
        assert anomaly.top_priority_anomalies(df).count() == sum(r["is_anomaly"] for r in out)


def test_scores_leave_no_files(spark):
    import os
    from ledgerlens.session import configured_checkpoint_dir
    folder = os.path.join(configured_checkpoint_dir(spark).replace("file:", "", 1), "tables")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert iforest.isolation_forest_scores(_planted(spark, 2), "id", FEATURES, n_trees=10).count() == 2020
    assert set(os.listdir(folder)) == before


def test_only_the_score_is_written(spark, monkeypatch):
    written = []
    keep = iforest.materialize
    monkeypatch.setattr(iforest, "materialize", lambda df, as_table=False: (written.append(df.columns), keep(df, as_table))[1])
    iforest.isolation_forest_scores(_planted(spark, 2), "id", FEATURES, n_trees=5).count()
    assert written == [["_ss"]]


def test_a_failed_write_is_an_error(spark, monkeypatch):
    import pytest
    from ledgerlens import session
    monkeypatch.setattr(session, "configured_checkpoint_dir", lambda s: "nosuchscheme://nowhere")
    with pytest.raises(Exception):
        session.materialize(spark.range(3), as_table=True)


def test_chunked_scoring_equals_whole_batch(spark):
    model = iforest.fit(_planted(spark, 2), "id", FEATURES, n_trees=10, max_samples=64, seed=2)
    x = np.random.default_rng(0).normal(size=(1000, 3))
    assert np.array_equal(model.score_samples(x, chunk=97), model.score_samples(x, chunk=10**6))


def test_select_ranks_with_infinities(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=500), [np.inf] * 7, [-np.inf] * 3])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    srt = np.sort(v)
    ranks = [0, 2, 3, 250, 502, 503, 509]
    got = select_ranks(df, "v", ranks, bins=8)
    assert [got[r] for r in ranks] == [srt[r] for r in ranks]


def test_scores_do_not_depend_on_the_chunk_and_are_quick():
    """Trees are walked one after the other in the cache; all trees at once took over three times as long."""
    import time

    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 4))
    nodes = [(t, *n) for t in range(150) for n in iforest.grow_tree(x[rng.choice(len(x), 256, False)], 1, t, 8)]
    model = iforest.IsolationForestModel.from_nodes(pd.DataFrame(nodes, columns=iforest.NODE_SCHEMA.fieldNames()), 256, 8, 4)

    def at_once(x):
        flat, width = x.ravel(), 256
        row = (np.arange(len(x), dtype=np.int32) * 4)[:, None]
        base = (np.arange(150, dtype=np.int32) * width)[None, :]
        node = np.ones((len(x), 150), np.int32)
        for _ in range(8):
            at = base + node
            node += node
            node += flat.take(row + model.step_feature.take(at)) > model.step_threshold.take(at)
        path = model.ends.take(base + (node - width)).sum(axis=1) / (iforest.PATH_UNITS * 150)
        return -np.power(2.0, -path / float(iforest.average_path_length([256])[0]))

    def took(f):
        t = time.perf_counter()
        return f(x), time.perf_counter() - t

    want, slow = min((took(at_once) for _ in range(3)), key=lambda r: r[1])
    got, quick = min((took(model.score_samples) for _ in range(3)), key=lambda r: r[1])
    assert np.array_equal(got, want) and np.array_equal(model.score_samples(x, 77), want) and quick < 0.8 * slow
