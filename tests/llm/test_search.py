import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import A_Z, SF, documents, empty
from compare import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(A_Z))


def brute(docs, items, k=10):
    """docs: (doc_id, text) rows; items: (item_id, text) rows."""
    docs = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in {(i, t) for i, t in items if i is not None and t is not None}:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for d, c in docs:
            score = 0
            for t in ts:
                if c[t]:
                    m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("share,piece", [(16, 1 << 22), (2, 3000), (100_000, 20_000)])
def test_equals_brute_force(spark, monkeypatch, share, piece):
    monkeypatch.setattr(search, "SHORT_SHARE", share)
    monkeypatch.setattr(search, "PIECE_BYTES", piece)
    monkeypatch.setattr(search, "FAN", 2)
    docs = documents(spark, {"item_id": "string", "score": "long", "rank": "int"}).repartition(5)
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    asked = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    asked += [(900, "word1x1 WORD1X1 word2x2 the"), (901, None), (902, ""), (903, "-- !!"), (904, "nowhereatall"), (None, "the of"),
              (905, "the and of er in"), (905, "the and of er in"), (905, "more the"), (906, "naïve ÉCOLE 日本語"), (907, "x y " * 2000)]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert rows(search.search(docs, items)) == brute(given, asked)
    monkeypatch.setattr(search, "BLOCK_BYTES", 2000)         # many blocks of items
    assert rows(search.search(docs, items, 3)) == brute(given, asked, 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1), min_size=1, max_size=8), st.integers(1, 12),
       st.integers(1, 30), st.randoms())
def test_lists_give_the_best_documents(given, k, short, rng):
    ids = np.array(rng.sample(range(1000), 61))
    lists = [(np.array(sorted(x)), np.array([x[d] for d in sorted(x)])) for x in given]
    total = Counter()
    for x in given:
        total.update(x)
    best = search.Best(k)
    search.search_lists(lists, ids, best, short)
    search.search_lists([(np.array([0]), np.array([1]))], np.array([5000]), best, short)     # another piece
    want = sorted([(-s, ids[d]) for d, s in total.items()] + [(-1, 5000)])[:k]
    assert [(-s, d) for s, d in zip(best.score, best.doc)] == want


def test_long_lists_are_skipped(monkeypatch):
    """Once ten documents with the rare term are found, the others of the common one are not looked at."""
    seen = []
    real = search._values_at
    monkeypatch.setattr(search, "_values_at", lambda one, docs: seen.append(len(docs)) or real(one, docs))
    common = (np.arange(100_000), np.full(100_000, 3))
    rare = (np.arange(0, 100_000, 5000), np.full(20, 50))
    best = search.Best(10)
    search.search_lists([common, rare], np.arange(100_000), best, 100)
    assert list(best.doc) == list(range(0, 50_000, 5000)) and sum(seen) < 2000


def test_empty(spark):
    no_docs, no_items = empty(spark), empty(spark, "item_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    blank = spark.createDataFrame([(1, "--"), (2, None), (3, "")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert rows(search.search(no_docs, items)) == rows(search.search(docs, no_items)) == rows(search.search(blank, items)) == []


def test_oracle(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    ok, why = compare(search.op11_lexical_search(spark, SF), con, search.ORACLE_SQL)
    assert ok, why
