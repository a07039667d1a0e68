from brute import documents, empty, words

from ledgerlens.llm import substrings


def expected(rows, width=50):
    """rows: (doc_id, text); kept words by (doc_id, text)."""
    first = {}
    split = [(d, t, words(t)) for d, t in rows]
    for d, _, w in sorted(split, key=lambda x: x[0]):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i:i + width]), d)
    out = {}
    for d, t, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out[d, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_against_brute_force(spark):
    df = documents(spark, {"n_words": "int", "spans": "int", "bin": "string"})
    rows = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None]
    got = substrings.remove_repeats(df).collect()
    assert len(got) == len(rows)
    want = {}
    for (d, t), v in expected(rows).items():
        want.setdefault(d, v)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]], r["doc_id"]
    assert sum(r["n_removed"] for r in got) > 1000


def test_many_copies_over_many_partitions(spark):
    """One passage in most documents, a third of them exact copies; small windows."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, "copy " + passage if i % 3 == 0 else f"own{i} {passage} end{i} " + " ".join(f"w{i}_{j}" for j in range(20)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(37)
    want = expected(rows, 20)
    for r in substrings.remove_repeats(df, width=20).collect():
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"], dict(rows)[r["doc_id"]]]


def test_empty(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0
