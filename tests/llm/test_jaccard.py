import random

import numpy as np
import pytest
from brute import components, documents, empty, shingles

from pyspark.sql import functions as F

from ledgerlens.llm import jaccard


def expected(rows, percent=75):
    sets = [(d, shingles(t)) for d, t in rows]
    edges = []
    by_gram = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    seen = set()
    for group in by_gram.values():
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                seen.add((group[a], group[b]))
    for a, b in seen:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            edges.append((sets[a][0], sets[b][0]))
    top = components({d for d, _ in sets}, edges)
    return sorted((d, len(s), top[d]) for d, s in sets)


def check(spark, df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df).collect())
    assert got == expected(rows)
    return got


def test_documents(spark):
    got = check(spark, documents(spark, {"component_id": "string", "n_shingles": "int", "h1": "int", "batch": "int"}))
    assert any(d != c for d, _, c in got)


@pytest.mark.parametrize("column_rows", [1024, 5])
def test_chains_groups_and_a_common_passage(spark, monkeypatch, column_rows):
    """Near copies of a text that link only through others, chains, many exact
    copies, and a passage that all share but few link by."""
    monkeypatch.setattr(jaccard, "COLUMN_ROWS", column_rows)      # 5: hot columns as many cells
    draw = random.Random(4)
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    passage, rows = fresh(40), []
    origin = fresh(160)
    for i in range(60):
        copy = list(origin)
        for at in draw.sample(range(160), draw.choice((1, 2, 4, 6, 8))):
            copy[at] = fresh(1)[0]
        rows.append(" ".join(copy))
    chain = fresh(100)
    for i in range(25):
        rows.append(" ".join(chain))
        at = 4 * i % 100
        chain = chain[:at] + fresh(2) + chain[at + 2:]
    rows += [" ".join(fresh(30) + passage + fresh(30)) for _ in range(60)]
    rows += [" ".join(passage + fresh(draw.choice((6, 14, 20)))) for _ in range(30)]
    rows += [" ".join(origin)] * 40
    draw.shuffle(rows)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(7)
    check(spark, df)


def test_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    only = spark.createDataFrame([(3, None), (4, ""), (5, "a")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(only).collect()) == [(3, 0, 3), (4, 0, 4), (5, 1, 5)]


def test_a_passage_of_many_documents_makes_few_pairs():
    """2,000 texts with 36 common columns of 46 shingles: no two can link, and no pair is made."""
    n, columns = np.full(2000, 46), np.full(2000, 36)
    some = jaccard.column_pairs(np.arange(2000), np.arange(2000), np.zeros(2000), n, columns, 75, False)
    assert len(some) == 0
    columns[:3] = 46
    some = jaccard.column_pairs(np.arange(2000), np.arange(2000), np.zeros(2000), n, columns, 75, False)
    assert sorted(map(tuple, some.tolist())) == [(0, 1), (0, 2), (1, 2)]
    some = jaccard.column_pairs(np.arange(2000), np.r_[7, 7, np.arange(2, 2000)], np.arange(2000) % 2, n, columns, 75, True)
    assert some.tolist() == [[2, 1]] or some.tolist() == [[1, 2]]


def test_bounds_lose_no_link():
    """Whatever two sets share, sets that link may link by their sizes and columns."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        both, only = rng.integers(1, 60), rng.integers(0, 25, 2)
        n = both + only
        own = np.minimum(rng.integers(0, 5, 2), only)                 # columns that no other row has
        links = 100 * both >= 75 * (n.sum() - both)
        assert not links or jaccard.may_link(n, n - own, 75)[0, 1]


def test_cells_of_a_long_column_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMN_ROWS", 7)
    rows = spark.range(50).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("h"), F.lit(50).cast("long").alias("m"))
    cells = {}
    for r in jaccard.in_cells(rows).collect():
        cells.setdefault((r["cell"], r["apart"]), []).append((r["node"], r["block"]))
    seen = [(a, b) for (_, apart), xs in cells.items() for a, x in xs for b, y in xs if a < b and (not apart or x != y)]
    assert len(seen) == len(set(seen)) == 50 * 49 // 2 and max(map(len, cells.values())) < 30
