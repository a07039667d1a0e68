"""The stages on the smallest table and planted rows; the entry without this package."""

import shutil
import subprocess
import sys

import pytest
from brute import SF, shingles
from conftest import ROOT

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = [r["text"] for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(
        "quality = 1 and n_chars > 1500").orderBy("doc_id").limit(3).collect()]
    junk = "BUY!! NOW!! " * 200
    rows = [(500_000, clean[0]), (500_001, clean[1].replace(" the ", " a ", 1)), (500_002, clean[2] + " " + item), (500_003, junk),
            (500_004, None), (500_005, ""), (None, clean[0])]
    more = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in rows], docs.schema)
    frames = [docs.unionByName(more)]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.materialize(stage(spark, frames[-1], SF), as_table=True))
    return frames


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "ngram_join", "decontaminate", "bpe"]
    assert all(f.columns == stages[0].columns for f in stages[1:-1])
    assert set(stages[0].columns) < set(stages[-1].columns) and stages[-1].count() == stages[-2].count()


def test_decisions_take_effect(stages):
    given, good, lined, joined, clean, _ = stages
    assert 500_003 not in ids(good) and 0.7 < good.count() / given.count() < 1
    assert 500_000 not in ids(lined)                       # all its lines are in a smaller document
    texts = [r["text"] for r in joined.collect() if r["doc_id"] is not None]
    sets = [s for s in map(shingles, texts) if s]
    for i, a in enumerate(sets):
        for b in sets[i + 1:]:
            both = len(a & b)
            assert 100 * both < 75 * (len(a) + len(b) - both)
    assert ids(joined) - ids(clean) <= {r["doc_id"] for r in joined.collect()} and 500_002 not in ids(clean)


def test_entry_without_the_package(tmp_path):
    """Without the optional folders the entry still imports and has the other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    n, numbered, pipeline = out.stdout.split()[-3:]
    assert int(n) >= 41 and numbered == "False" and pipeline == "False", out.stderr[-500:]


def test_all_queries_are_registered():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert {"op2_chat_format", "op10_token_counts"} <= set(entry.oracle_sql())
