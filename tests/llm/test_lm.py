import math
import zlib
from collections import Counter

import pytest
from brute import documents, empty, words
from pyspark.sql import functions as F

from ledgerlens.llm import lm


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1


def expected(rows, order, weight):
    end = "\0"
    texts = [(d, words(t, lower=True) + [end]) for d, t in rows]
    count = Counter()
    for d, t in texts:
        if not held(d):
            padded = [end] * (order - 1) + t
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    count[tuple(padded[i - k + 1:i + 1])] += 1
    docs = count[(end,)]
    n = sum(c for g, c in count.items() if len(g) == 1)
    z = n + 0.5 * (sum(len(g) == 1 for g in count) + 1)
    out = []
    for d, t in texts:
        padded, base, model = [end] * (order - 1) + t, 0.0, 0.0
        for i in range(order - 1, len(padded)):
            p = (count[(padded[i],)] + 0.5) / z
            base += math.log10(p)
            for k in range(1, order):
                context = tuple(padded[i - k:i])
                c = docs if i == order - 1 else count[context]
                p = (count[context + (padded[i],)] + weight * p) / (c + weight)
            model += math.log10(p)
        out.append((d, held(d), len(t), sum(count[(w,)] > 0 for w in t), n, base, model))
    return sorted(out)


@pytest.mark.parametrize("order,weight,stretch", [(2, 100.0, 512), (3, 5.0, 512), (3, 5.0, 7), (1, 1.0, 512), (4, 2.0, 3)])
def test_against_brute_force(spark, monkeypatch, order, weight, stretch):
    monkeypatch.setattr(lm, "STRETCH", stretch)
    df = documents(spark, {"score": "int", "batch": "int", "held_out": "string"})
    rows = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None]
    got = sorted(tuple(r) for r in lm.score(df, held_out(), order=order, weight=weight).collect())
    want = expected(rows, order, weight)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_better_than_the_base_on_held_out_texts(spark):
    rows = lm.op5_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_empty_and_untrained(spark):
    assert lm.score(empty(spark), held_out()).count() == 0
    row = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["score"] == pytest.approx(0.0)


def batch_of(texts, held, order):
    import numpy as np
    import pyarrow as pa
    listed, count, place, first, _ = lm._listed(pa.array(texts), np.array(held), order)
    return count.astype(float), place, first


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_stretches_walk_like_whole_texts(order):
    import random

    import numpy as np
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 300]))) for _ in range(60)]
    count, place, first = batch_of(texts, [i % 3 == 0 for i in range(60)], order)
    model = lm.Automaton(count, place, first, 100.0, 2.0)
    whole = model.walk(place[0], first, 10**6)
    for stretch in (1, 2, 3, 50):
        assert np.allclose(model.walk(place[0], first, stretch), whole, rtol=0, atol=1e-9)


def test_states_arcs_and_failure_arcs():
    """The automaton of "a b" and "a c": what a state has, and where it leads."""
    import numpy as np
    count, place, first = batch_of(["a b", "a c", "b a"], [False, False, True], 2)
    model = lm.Automaton(count, place, first, 10.0, 4.0)
    a, b, c, end = place[0][0], place[0][1], place[0][4], place[0][2]
    state = lambda e: 1 + e
    seen = {(model.start, a): a, (state(a), b): b, (state(a), c): c, (state(b), end): end, (state(c), end): end}
    assert {(k // model.entries, k % model.entries): t - 1 for k, t in zip(model.key.tolist(), model.arc_to.tolist())} == seen
    assert model.fail[state(a)] == 0 and model.fail_log[state(a)] == pytest.approx(math.log10(4 / (2 + 4)))
    to, log = model.step(np.array([state(a), state(b)]), np.array([b, a]))
    p_b, p_a = 1.5 / 10, 2.5 / 10
    assert to.tolist() == [state(b), state(a)]
    assert log[0] == pytest.approx(math.log10((1 + 4 * p_b) / (2 + 4)))              # an arc
    assert log[1] == pytest.approx(math.log10(4 / (1 + 4) * p_a))                    # failure, then the root's arc


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 313}" for i in range(400_000))
    rows = [(0, long), (1, "w1 w2"), (2, None)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    want = {d: s for d, *_, s in expected_all(rows)}
    for d in want:
        assert got[d]["score"] == pytest.approx(want[d], rel=1e-9)


def expected_all(rows):
    global held
    keep, held = held, lambda d: False
    try:
        return expected(rows, 2, lm.WEIGHT)
    finally:
        held = keep
