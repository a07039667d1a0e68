import numpy as np
import pyarrow as pa
from brute import SF, documents, empty

from ledgerlens.llm import quality as Q


def test_held_out_accuracy(spark):
    got = Q.op8_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    judged = got.merge(labels, on="doc_id")
    held = judged[judged.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    x, first = rng.normal(size=(17, Q.FEATURES)), np.array([0, 4, 5, 11, 17])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.3, 0.2, 0.1, 0.4])
    model = Q.AttentionModel.start(x)
    loss = lambda: -(weight * np.log(np.where(y == 1, s := model.forward(x, first)["score"], 1 - s))).sum()   # noqa: E731,F841
    gradient = model.gradient(model.forward(x, first), first, y, weight)
    for name, value in gradient.items():
        flat = model.p[name].reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-6
            up = loss()
            flat[i] = keep - 1e-6
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-6 - value.reshape(-1)[i]) < 1e-5, name


def test_passages_cover_the_text():
    texts = [None, "", "A b", "x " * 64, "x " * 65, "ÄÖ !! \n" * 200]
    x, first = Q.passages(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [1, 1, 1, 1, 2, 7] and x.shape == (13, Q.FEATURES) and np.isfinite(x).all()
    alone = [Q.passages(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x)


def test_odd_rows_and_clashing_columns(spark):
    df = documents(spark, {"score": "string", "Predicted": "int", "extra": "int"})
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1), (5, 7)], "doc_id long, quality int")
    out = Q.classify(df, labels.unionByName(odd))
    rows = out.collect()
    assert set(out.columns) == {"doc_id", "text", "extra", "held_out", "score", "predicted"} and len(rows) == df.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    twice = [r["score"] for r in rows if r["doc_id"] == 1_000_008]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_without_labels(spark):
    df = documents(spark)
    none = empty(spark, "doc_id long, quality int")
    assert {r["score"] for r in Q.classify(df, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert {r["predicted"] for r in Q.classify(df, ones).collect()} == {1}
    assert Q.classify(empty(spark), none).count() == 0


def test_a_batch_is_scored_in_little_memory():
    """Pieces of 8 MB of text took 174 MB at most, those of 1 MB take 24 MB."""
    import tracemalloc

    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 99999, 350)) for _ in range(4000)])
    x, _ = Q.passages(texts.slice(0, 50))
    model = Q.AttentionModel.start(x)
    want = np.concatenate([model.forward(*Q.passages(texts.slice(i, 100)))["score"] for i in range(0, 4000, 100)])
    tracemalloc.start()
    got = Q.scores_of(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, atol=1e-12) and peak < 60e6, peak
