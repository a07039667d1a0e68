"""Plain-Python versions of the contracts, and the rows the tests share."""

from __future__ import annotations

import re

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(A_Z) if lower else text)


def odd_texts():
    """Empty, short, long, repeated and near texts."""
    base = " ".join(f"word{i % 61}x{i}" for i in range(300))
    near = base.replace("word7x7 ", "other ")
    return [None, "", "   \n\t ", "one", "Two words", "a b c d", "A b C d", "x " * 4000, base, near, base, base.upper(),
            " ".join(base.split(" ")[:120]), "naïve ÉCOLE ñ 日本語   x", "y" * 5000, "tail " + base]


def documents(spark, clashing: dict[str, str] | None = None):
    """All documents of the smallest table and the odd texts, with more columns of the given names and types."""
    from pyspark.sql import functions as F

    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(1_000_000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "no id here at all"), (1_000_008, odd_texts()[8])]
    out = given.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    for name, kind in (clashing or {}).items():
        out = out.withColumn(name, F.lit("7").cast(kind))
    return out


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None}


def shingles(text, k=5):
    w = words(text, lower=True)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
