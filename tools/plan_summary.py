"""Physical-plan summary of every registered query, as a Markdown table.

    python tools/plan_summary.py [sf_dir] [broadcast_threshold_bytes]

The broadcast threshold defaults to 1 MB so that, at a small scale factor,
only the fixed-size dimensions are broadcast, as they would be at a large
one. "jobs run" counts the Spark jobs of building and running the query
(broadcast builds and subqueries are jobs of their own); operator counts are
from the static plan, where a subquery appears once per reference although
it runs once. The forest and sampling queries run their fit/selection jobs
while the plan is built (the table shows the final scoring plan).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNTS = [
    ("hash shuffles", r"^Exchange hashpartitioning"),
    ("range shuffles", r"^Exchange rangepartitioning"),
    ("to one partition", r"^Exchange SinglePartition"),
    ("broadcasts", r"^BroadcastExchange"),
    ("sort-merge joins", r"^SortMergeJoin"),
    ("broadcast joins", r"^BroadcastHashJoin"),
    ("subquery references", r"^Subquery subquery"),
    ("top-k", r"^TakeOrderedAndProject"),
    ("windows", r"^Window"),
    ("Python stages", r"^(ArrowEvalPython|FlatMapGroupsInPandas)"),
    ("cartesian / nested loop", r"^(CartesianProduct|BroadcastNestedLoopJoin)"),
]


def summarize(text: str) -> dict[str, int]:
    # Operator lines of the tree, without the tree drawing; a subquery that
    # is referenced twice prints the same operators (same ids) twice, so
    # identical lines are counted once.
    ops = {re.sub(r"^[\s:+\-|]*", "", l) for l in text.splitlines()}
    return {name: sum(1 for op in ops if re.search(rx, op)) for name, rx in COUNTS}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    threshold = sys.argv[2] if len(sys.argv) > 2 else str(1 << 20)
    from ledgerlens.plans.registry import all_queries
    from ledgerlens.session import build_session
    spark = build_session(extra={"spark.sql.autoBroadcastJoinThreshold": threshold})
    sc = spark.sparkContext
    print("| query | jobs run | " + " | ".join(n for n, _ in COUNTS) + " |")
    print("| --- | --- |" + " --- |" * len(COUNTS))
    for name, q in all_queries().items():
        buf = io.StringIO()
        sc.setJobGroup(name, name)
        df = q(spark, sf_dir)
        with contextlib.redirect_stdout(buf):
            df.explain("simple")
        df.write.format("noop").mode("overwrite").save()
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        s = summarize(buf.getvalue())
        print(f"| `{name}` | {jobs} | " + " | ".join(str(s[n]) for n, _ in COUNTS) + " |")
        spark.catalog.clearCache()
    spark.stop()


if __name__ == "__main__":
    main()
