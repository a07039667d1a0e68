"""A short boilerplate in most documents: its windows differ, share their anchor, and are dealt over several bins."""

import numpy as np
import pyarrow as pa
from test_substrings import expected

from ledgerlens.llm import substrings


def test_hot_anchor(spark):
    boiler = " ".join(f"b{i}" for i in range(30))
    rows = [(i, " ".join(f"u{i}_{j}" for j in range(40)) + f" {boiler} " + " ".join(f"v{i % 150}_{j}" for j in range(40)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealing = substrings.deal(substrings._numbered(df, "doc_id", "text"), 50, 4)
    columns = np.array([i for i, _ in rows]), np.zeros(len(rows), np.int64)
    load = np.zeros(dealing.bins, np.int64)
    for to, message in substrings._window_entries(pa.array([t for _, t in rows]), *columns, 50, dealing):
        if np.frombuffer(message, np.int64, 1)[0] > 0:
            load[to] += substrings._read(message, (np.uint64, np.int64, np.int64, np.uint32, np.uint32))[4].sum()
    assert load.sum() > 10_000 and load.max() < 3 * load.mean()
    want = expected(rows)
    got = substrings.remove_repeats(df).collect()
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) > 0
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"], dict(rows)[r["doc_id"]]]
