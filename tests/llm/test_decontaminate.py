from collections import Counter

import numpy as np
from brute import SF, documents, empty, words

from ledgerlens.llm import decontaminate as D


def expected(docs, items):
    grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    index = {k: (len(w), grams(w)) for k, t in items if len(w := words(t, lower=True)) >= 5}
    short = {k: w for k, t in items if 0 < len(w := words(t, lower=True)) < 5}
    out = {}
    for d, t in docs:
        w = words(t, lower=True)
        own = grams(w)
        for k, x in short.items():
            if any(w[i:i + len(x)] == x for i in range(len(w) - len(x) + 1)):
                out[d, k] = 1.0
        for k, (n, g) in index.items():
            if own.keys() & g.keys():
                for s in range(max(1, len(w) - n + 1)):
                    c = grams(w[s:s + n])
                    both = sum((c & g).values())
                    value = both / (sum(c.values()) + sum(g.values()) - both)
                    if value >= 0.75:
                        out[d, k] = max(out.get((d, k), 0), value)
    return out


def test_against_brute_force(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    long_item = next(t for _, t in items if len(t.split()) > 35)
    w = long_item.split()
    planted = [long_item.upper(), " ".join(w[:10] + ["changed"] + w[11:]), " ".join(w[1:]), " ".join(w[:-6]),
               "before " * 30 + " ".join(w[:20] + w[21:]) + " after" * 30, " ".join(w[:12]), " ".join(w + w)]
    df = documents(spark, {"matches": "int", "item_id": "string", "contaminated_": "int"})
    more = spark.createDataFrame([(2_000_000 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    df = df.unionByName(more, allowMissingColumns=True)
    bench = bench.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "the"), (9004, items[0][1])],
                                                    "item_id long, text string"))
    items += [(9003, "the"), (9004, items[0][1])]
    docs = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None]
    want = expected(docs, items)
    got = {(r["doc_id"], r["item_id"]): r for r in D.find(df, bench).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k]["similarity"] - want[k]) < 1e-12 for k in want)
    assert {d for d, _ in want} & {2_000_000, 2_000_001, 2_000_002, 2_000_004}
    bench, want = bench.where("item_id <> 9003"), {k: v for k, v in want.items() if k[1] != 9003}
    clean = D.without_contaminated(df, bench)
    assert clean.columns == df.columns
    left = [r["doc_id"] for r in clean.collect()]
    assert Counter(left) == Counter([d for d, _ in docs if d not in {x for x, _ in want}] + [None])


def test_chunks_of_items_give_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(tuple(r) for r in D.find(docs.select("doc_id", "text"), bench).collect())
    monkeypatch.setattr(D, "CHUNK_BYTES", 4000)
    assert sorted(tuple(r) for r in D.find(docs.select("doc_id", "text"), bench).collect()) == whole


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    masks = set(D.near_masks(D.RADIUS // D.BLOCKS).tolist())
    for _ in range(300):
        a = rng.integers(0, 2, 128)
        b = a.copy()
        b[rng.choice(128, D.RADIUS, replace=False)] ^= 1
        a, b = (np.packbits(x.astype(np.uint8)).view(np.uint16) for x in (a, b))
        assert D.distance(a[None, :], b)[0] == D.RADIUS
        assert any(int(x) in masks for x in a ^ b)


def test_empty(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert D.find(empty(spark), bench).count() == 0
    none = empty(spark, "item_id long, text string")
    assert D.find(documents(spark), none).count() == 0
    assert D.without_contaminated(documents(spark), none).count() == documents(spark).count()


def test_short_items(spark):
    """Items of one to four words, at text ends, across texts, twice, equal and null ids."""
    docs = [(1, "Alpha beta gamma delta"), (2, "gamma delta epsilon"), (3, "alpha  BETA"), (4, "beta"), (5, ""), (6, None), (7, "beta alpha beta alpha")]
    items = [(10, "alpha beta"), (11, "ALPHA beta"), (12, "beta gamma delta epsilon"), (13, "alpha beta gamma delta"), (14, "beta"), (None, "delta")]
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1),
                 spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["from_word"], r["n_words"]) for r in got) == [
        (1, 0, 3, 1), (1, 10, 0, 2), (1, 11, 0, 2), (1, 13, 0, 4), (1, 14, 1, 1), (2, 0, 1, 1), (3, 10, 0, 2), (3, 11, 0, 2),
        (3, 14, 1, 1), (4, 14, 0, 1), (7, 10, 1, 2), (7, 11, 1, 2), (7, 14, 0, 1)]
    assert all(r["similarity"] == 1.0 and r["distance"] == 0 for r in got)


def test_a_long_text_takes_bounded_memory(monkeypatch):
    """Ten megabytes with the item at both ends: the same windows, no sums for all words between."""
    import pyarrow as pa
    item = " ".join(f"item{i}" for i in range(40))
    fill = " ".join(f"w{i % 4999}" for i in range(1_600_000))
    index = D.Items([1], [item], D.RADIUS, D.SIMILARITY)
    widest, real = [], D._running
    monkeypatch.setattr(D, "_running", lambda h: (widest.append(len(h)), real(h))[1])
    text = f"{item} {fill} {item[:-8]} changed {item} end"
    assert len(text) > 9_000_000
    (found,) = index.search(pa.array([text]))
    assert [m[:4] for m in found] == [(1, 0, 40, 1.0)] and max(widest) <= D.RUN_WORDS + 40
    monkeypatch.setattr(D, "RUN_WORDS", 1 << 30)
    assert index.search(pa.array([text[-400_000:]])) != [[]]


def test_codes_in_stretches_equal_codes_at_once(monkeypatch):
    h = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    start = np.unique(np.random.default_rng(3).integers(0, 4900, 700))
    run = D._running(h)
    want = D.packed(run[start + 90] - run[start])
    for step in (1, 7, 100, 10**6):
        monkeypatch.setattr(D, "RUN_WORDS", step)
        assert np.array_equal(D.window_codes(h, start, 90), want)
