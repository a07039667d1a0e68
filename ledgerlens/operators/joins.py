"""Join strategy.

Joins are plain equi-joins and the broadcast decision is normally Spark's:
the planner broadcasts a side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold``, AQE re-checks with the actual stage
size at run time, and anything larger is shuffled (sort-merge, with AQE
skew splitting). No hint is placed on data whose size grows.

One exception: a dimension joined on a *low-cardinality* key (nation, 25
values) must not be shuffle-joined, because hashing a large fact table by 25
keys puts it into 25 tasks. Such a dimension is broadcast explicitly, after a
row-count check against a fixed bound (``bounded_broadcast``); if the check
fails it is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION_ROW_LIMIT = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = DIMENSION_ROW_LIMIT) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``.

    The check reads at most ``max_rows + 1`` rows of the dimension alone, each
    time a plan is built: the files may have grown since the last.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
