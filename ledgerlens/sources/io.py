"""Sources and sinks of the two operational tables.

CSV is read with the fixed schema (no inference pass); Parquet is the stored
form. Writers replace the target as a whole and write one directory of part
files per table, in parallel from the executors.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from .schemas import SUPPORT_TICKETS, TRANSACTIONS
from .snapshots import open_snapshot

SCHEMAS = {"transactions": TRANSACTIONS, "support_tickets": SUPPORT_TICKETS}
ORDER_KEYS = {"transactions": ["timestamp", "transaction_id"], "support_tickets": ["created_at", "ticket_id"]}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A header CSV (file or directory) of ``table`` with its fixed schema.

    Empty fields read as null. Timestamps parse with or without fractional
    seconds.
    """
    return (spark.read.schema(SCHEMAS[table]).option("header", True)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
            .option("mode", "FAILFAST").csv(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 in each file: rows are
    numbered where a split is read, and splits by the rows of those before them."""
    meta = F.col("_metadata")
    rows = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("at"),
                                        F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    # The splits of one file: a row each.
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "at", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(splits, ["file", "at"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def read_csv_quarantined(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a header CSV: the records that fit the fixed schema, and
    (file, line, reason, record) of those that do not. ``read_csv`` stays strict: a bad
    record there is an error. Records are lines; each file's first line is its header."""
    schema, options = SCHEMAS[table], {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad",
                                       "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
    names = [f.name for f in schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    lines = numbered_lines(spark, path).where("line > 1 and value <> ''")
    parsed = lines.select("file", "line", "value", F.from_csv("value", F.lit(f"{ddl}, `_bad` string"), options).alias("r"))
    required = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            required = required & F.col(f"r.{f.name}").isNotNull()
    good = F.col("r._bad").isNull() & required
    rows = parsed.where(good).select(*(F.col(f"r.{n}").alias(n) for n in names))

    # The same record as strings, with one field more than there should be.
    text = F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in [*names, "_more"])), {"mode": "PERMISSIVE"})
    bad = parsed.where(~good).select("file", "line", "value", "r", text.alias("t"))
    fields = F.when(F.col("t._more").isNotNull(), F.lit(f"more than {len(names)} fields"))
    last = F.col(f"t.{names[-1]}").isNull()
    wrong = [F.when(F.col(f"t.{f.name}").isNotNull() & F.col(f"r.{f.name}").isNull(),
                    F.concat(F.lit(f"{f.name}: "), F.col(f"t.{f.name}"), F.lit(f" is no {f.dataType.simpleString()}")))
             for f in schema.fields if f.dataType.simpleString() != "string"]
    missing = [F.when(F.col(f"r.{f.name}").isNull() & F.col("r._bad").isNull(), F.lit(f"{f.name} is missing"))
               for f in schema.fields if not f.nullable]
    short = F.when(last, F.lit(f"fewer than {len(names)} fields"))
    reason = F.coalesce(fields, *missing, *wrong, short, F.lit("not a record"))
    return rows, bad.select("file", "line", reason.alias("reason"), F.col("value").alias("record"))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """Store a frame as catalog table ``name`` at ``path``, bucketed and sorted by ``key``,
    one file a bucket: joins on the key of tables with as many buckets need no shuffle."""
    (df.repartition(buckets, key).write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The stored (Parquet) table, cast to the fixed schema in its column order."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def read_partitioned_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table written with ``partition_by_date``; the ``_date`` directory
    column stays available for partition pruning."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields], "_date")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path`` (any file-system scheme)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def files_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the paths, sizes and modification times of all files below some paths."""
    found = []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def load_stored(spark: SparkSession, table_dir: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored tables, with ``_date`` kept when they are stored by day (the
    view filters prune directories by it and leave it out of their result).
    Where builds have made snapshots, both are of one version, by default the
    last, whatever is built later."""
    found = open_snapshot(spark, table_dir, version)
    out = []
    for name in SCHEMAS:
        df = found.read(name) if found else spark.read.parquet(f"{table_dir}/{name}")
        days = ["_date"] if "_date" in df.columns else []
        out.append(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields], *days))
    return out[0], out[1]


def load_data(spark: SparkSession, table_dir: str, csv_dir: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, support_tickets): both from storage when both are there,
    else both from the CSV files; never one of each. A table that is there but
    cannot be read is an error."""
    if open_snapshot(spark, table_dir) or all(path_exists(spark, f"{table_dir}/{name}") for name in SCHEMAS):
        return load_stored(spark, table_dir)
    return tuple(read_csv(spark, f"{csv_dir}/{name}.csv", name) for name in SCHEMAS)


def write_table(df: DataFrame, path: str, partition_by_date: str | None = None, order: list[str] | None = None,
                observe: str | None = None) -> dict:
    """Replace the stored table at ``path``, in the given order: rows of a file
    are sorted, so that row-group statistics of the sort columns are narrow.
    With ``partition_by_date`` (a timestamp column), rows are laid out by
    calendar day so that date filters prune whole directories. The rows are
    rebalanced by day with AQE's ``rebalance`` (few files per day), which also
    splits a day holding a large share of the rows over several writers. With
    ``observe`` (a timestamp column), returns the rows and its first and last value
    as seen by the tasks that write, each of which counts once."""
    if partition_by_date:
        w = df.withColumn("_date", F.to_date(partition_by_date)).hint("rebalance", "_date")
        w = w.sortWithinPartitions("_date", *(order or []))
    else:
        w = df.orderBy(*order) if order else df
    seen = Observation() if observe else None
    if seen:
        w = w.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(observe).cast("string").alias("first"),
                      F.max(observe).cast("string").alias("last"))
    writer = w.write.mode("overwrite")
    (writer.partitionBy("_date") if partition_by_date else writer).parquet(path)
    return seen.get if seen else {}


def write_csv(df: DataFrame, path: str) -> None:
    """A header CSV directory (one part file per task), replacing ``path``."""
    (df.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def load_audit(txn: DataFrame, tickets: DataFrame) -> DataFrame:
    """(table, rows) for both tables; two partial counts, no data movement."""
    return (txn.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("transactions").alias("table"), "rows")
            .unionByName(tickets.agg(F.count(F.lit(1)).alias("rows"))
                         .select(F.lit("support_tickets").alias("table"), "rows")))


def preview(df: DataFrame, table: str, rows: int = K.PREVIEW_ROWS) -> DataFrame:
    """The first ``rows`` rows in stored (time, id) order: a per-task top-k
    then one small merge (``TakeOrderedAndProject``)."""
    return df.orderBy(*ORDER_KEYS[table]).limit(rows)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that several queries read (memory, spilling to disk)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

