"""Dense numbers for keys, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dense_numbers(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, no): 1, 2, 3, ... for the distinct keys that are not null, by the least
    ``order`` columns of each, then by key.

    Keys are range-partitioned and sorted; a key's number is its place in its
    partition plus the keys of the partitions before, of which there is a row each.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.struct(*order)).alias("o"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(first.repartitionByRange(parts, "o", "k").sortWithinPartitions("o", "k").select(
        "k", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("id")), as_table=True)
    counts = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    # One row a partition.
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("p", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(counts), "p").select(
        F.col("k").alias(key), (F.col("before") + F.col("id") - F.col("first") + 1).alias("no"))
