import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import ann


def brute(ids, v, queries, k=5):
    out, n = {}, np.sqrt((v * v).sum(axis=1))
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (v * v[i]).sum(axis=1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    hits = total = 0
    for q, rows in want.items():
        found = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        hits += len(found.keys() & dict(rows).keys())
        total += len(rows)
        for v, s in rows:
            assert v not in found or found[v] == pytest.approx(s, abs=1e-12)
    return hits / total


def test_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    ids, v = pdf.vec_id.to_numpy(), np.array([np.asarray(e, float) for e in pdf.embedding])
    got = ann.op1_ann(spark, "/root/testdata/sf0.1").collect()
    want = brute(ids, v, [i for i in ids if i % 50 == 0])
    assert len(got) == 5 * len(want) and recall(got, want) >= 0.9
    for q in want:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(own, own[1:]))


def test_many_cells_copies_and_odd_rows(spark, monkeypatch):
    """Small blocks, so that there are many cells; a third of the rows are one vector."""
    monkeypatch.setattr(ann, "BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_GROUP", 5)
    monkeypatch.setattr(ann, "LEAF", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 1200)] + 0.5 * rng.normal(size=(1200, 16))
    v[rng.choice(1200, 400, replace=False)] = centres[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [1.0] * 15 + [None]), (5150, [float("nan")] + [1.0] * 15),
           (5200, [float("inf")] + [1.0] * 15), (5250, [1.0, 2.0]), (None, [1.0] * 16), (5300, []), (7, v[7].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("q", F.lit(1))
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    want = brute(np.arange(1200), v, range(0, 1200, 50))
    assert {r["query_id"] for r in got} == set(want)
    assert recall(got, want) >= 0.9


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind), F.col("id") % 50 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 0.0])], kind), F.col("id") % 50 == 0).count() == 0
    two = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 0.0])], kind), F.col("id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in two] == [(0, 1, 1, 1.0)]
