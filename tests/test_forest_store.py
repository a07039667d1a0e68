"""A stored forest: saved, loaded, asked for several sensitivities without a fit or scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_forest import FEATURES, _planted

from ledgerlens.operators import forest_store, iforest
from ledgerlens.operators.forest_store import StoredForest, fingerprint, stored_forest

KEYS = ("id", "anomaly_score", "is_anomaly")


def rows(df):
    return sorted(tuple(r[c] for c in KEYS) for r in df.select(*KEYS).collect())


@pytest.fixture()
def counted(monkeypatch):
    """How often a fit ran and a score column was made."""
    seen = {"fits": 0, "scores": 0}
    fit, score = iforest.fit_nodes, iforest.score_column

    def counting(name, fn):
        def run(*args, **kw):
            seen[name] += 1
            return fn(*args, **kw)
        return run
    monkeypatch.setattr(iforest, "fit_nodes", counting("fits", fit))
    monkeypatch.setattr(iforest, "score_column", counting("scores", score))
    return seen


def test_another_contamination_runs_no_fit_and_no_scoring(spark, tmpdir_path, counted):
    df = _planted(spark, 3)
    forest = stored_forest(df, "id", FEATURES, 40, 128, 7, folder=tmpdir_path)
    assert counted == {"fits": 1, "scores": 1}
    for share in (0.0, 0.001, 0.02, 0.1, 0.5, 1.0):
        before = dict(counted)
        offset = forest.offset(share)
        assert counted == before
        want = iforest.isolation_forest_scores(df, "id", FEATURES, share, 40, 128, 7)
        assert rows(forest.scored(df, share)) == rows(want)
        scores = [r[1] for r in rows(want)]
        assert forest.anomaly_range(share) == (min(scores), max(scores)) and isinstance(offset, float)


def test_the_store_is_found_by_rows_and_parameters(spark, tmpdir_path, counted):
    df = _planted(spark, 3)
    first = stored_forest(df, "id", FEATURES, 20, 128, 7, folder=tmpdir_path)
    again = stored_forest(df.repartition(7).orderBy(F.rand(3)), "id", FEATURES, 20, 128, 7, folder=tmpdir_path)
    assert counted["fits"] == 1 and again.folder == first.folder
    stored_forest(df, "id", FEATURES, 21, 128, 7, folder=tmpdir_path)
    stored_forest(df, "id", FEATURES, 20, 128, 8, folder=tmpdir_path)
    stored_forest(df.withColumn("a", F.when(F.col("id") == "id00003", 9.5).otherwise(F.col("a"))), "id", FEATURES, 20, 128, 7,
                  folder=tmpdir_path)
    assert counted["fits"] == 4


def test_save_and_load(spark, tmpdir_path):
    df = _planted(spark, 2)
    made = StoredForest.fit(df, "id", FEATURES, f"{tmpdir_path}/f", 15, 64, 3)
    back = StoredForest.load(spark, f"{tmpdir_path}/f")
    assert back.meta == made.meta and back.meta["rows"] == 2020 and back.meta["psi"] == 64
    x = np.random.default_rng(0).normal(size=(200, 3))
    fresh = iforest.fit(df, "id", FEATURES, 15, 64, 3)
    assert np.array_equal(back.model.score_samples(x), fresh.score_samples(x))
    assert rows(back.scored(df, 0.03)) == rows(made.scored(df, 0.03))


def test_an_unfinished_fit_is_not_there(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(forest_store, "sketch_of", lambda scores: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        StoredForest.fit(_planted(spark, 2), "id", FEATURES, f"{tmpdir_path}/f", 5, 64, 3)
    assert StoredForest.load(spark, f"{tmpdir_path}/f") is None
    monkeypatch.undo()
    assert StoredForest.fit(_planted(spark, 2), "id", FEATURES, f"{tmpdir_path}/f", 5, 64, 3).meta["rows"] == 2020


def test_two_fits_at_once_count_once(spark, tmpdir_path):
    for _ in range(2):
        forest = StoredForest.fit(_planted(spark, 2), "id", FEATURES, f"{tmpdir_path}/f", 5, 64, 3)
    assert sum(r["n"] for r in forest.sketch) == 2020


def test_sketches_of_parts_add_up(spark, tmpdir_path):
    """Rows taken in later move the cut-off as if all had been scored at once."""
    df = _planted(spark, 3)
    forest = StoredForest.fit(df.where("id < 'id01000'"), "id", FEATURES, f"{tmpdir_path}/f", 15, 64, 3)
    assert forest.absorb("day=2/b%20", df.where("id between 'id01000' and 'id01500'")) and forest.absorb("", df.where("id > 'id01500'"))
    assert not forest.absorb("day=2/b%20", df)
    x = np.array([r[1:] for r in df.select("id", *FEATURES).collect()], dtype=float)
    scores = forest.model.score_samples(x)
    for opened in (forest, StoredForest.load(spark, f"{tmpdir_path}/f")):
        assert sum(r["n"] for r in opened.sketch) == 2020
        for share in (0.0, 0.02, 0.25, 1.0):
            assert opened.offset(share) == np.percentile(scores, 100 * share)


def test_no_rows_one_row_and_equal_rows(spark, tmpdir_path):
    df = _planted(spark, 1)
    for name, some in (("none", df.limit(0)), ("one", df.limit(1)), ("equal", df.withColumn("a", F.lit(1.0)).withColumn(
            "b", F.lit(None).cast("double")).withColumn("c", F.lit(0.0)))):
        forest = StoredForest.fit(some, "id", FEATURES, f"{tmpdir_path}/{name}", 5, 64, 3)
        assert not any(r[2] for r in rows(forest.scored(some, 0.02))), name
        assert rows(forest.scored(some, 0.02)) == rows(iforest.isolation_forest_scores(some, "id", FEATURES, 0.02, 5, 64, 3))


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (2, None)], "id long, a double")
    assert fingerprint(df) == fingerprint(df.repartition(3))
    assert fingerprint(df)[0] != fingerprint(df.limit(2))[0] != fingerprint(df.select("id", F.col("a").alias("b")).limit(2))[0]
    assert fingerprint(df.limit(0))[1] == 0


def test_missing_values_go_right_as_before(spark):
    """Walking full trees equals walking nodes, also for NaN and infinities."""
    model = iforest.fit(_planted(spark, 2), "id", FEATURES, n_trees=9, max_samples=64, seed=5)
    x = np.random.default_rng(1).normal(size=(60, 3))
    x[::7, 0], x[::5, 1], x[::11, 2] = np.nan, np.inf, -np.inf

    def path(row, node):
        while model.feature[node] >= 0:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.path[node]

    total = np.array([sum(path(r, t) for t in model.roots) for r in x])
    c = iforest.average_path_length([model.psi])[0]
    assert np.array_equal(model.score_samples(x), -np.power(2.0, -(total / (iforest.PATH_UNITS * 9)) / c))


def test_the_result_scores_rows_once(spark):
    """One Python scoring node in the plan of all anomalies: its statistics read no score."""
    from conftest import SF_SMALL

    from ledgerlens.plans.registry import all_queries
    plan = all_queries()["transaction_anomalies"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
