"""Session settings the library relies on.

Everything in the library takes a ``SparkSession`` (or DataFrames) from the
caller. ``build_session`` is a convenience for tests, the bench and the driver
entry; on a cluster the same settings belong in ``spark-defaults.conf``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that affect results, not only speed: naive timestamps are read as
# TIMESTAMP_NTZ, and the session zone only matters when a value is shown.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings for the execution model: adaptive re-planning (coalescing of small
# shuffle partitions, skew-join splitting, runtime broadcast choice under the
# size threshold that Spark checks itself) and Arrow for the Pandas UDF path.
EXECUTION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in {**RESULT_SETTINGS, **EXECUTION_SETTINGS, **(extra or {})}.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configured_checkpoint_dir(spark)
    return spark


MB = 1 << 20


def scale_settings(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Partition sizing for a given input size and cluster.

    Input splits stay at 128 MB (a Parquet row group or two). Shuffles start
    with about one partition per 256 MB of input — column pruning and
    map-side aggregation make the shuffled data much smaller than that — but
    never fewer than two per core and at most 100,000; AQE then coalesces
    small partitions towards 256 MB and splits skewed ones above 1 GB. At
    100 TB on 1,000 executors × 8 cores this gives 100,000 initial shuffle
    partitions, each well inside executor memory, spilling to disk if not.
    """
    parts = min(100_000, max(2 * total_cores, -(-input_bytes // (256 * MB))))
    return {
        "spark.sql.files.maxPartitionBytes": str(128 * MB),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * MB),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * MB),
    }


def input_bytes(path: str) -> int:
    """Total size of the files under a local folder (bench and tests only)."""
    total = 0
    for root, _, files in os.walk(path):
        total += sum(os.path.getsize(os.path.join(root, f)) for f in files)
    return total


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (``addPyFile``).

    Python stages (the forest's ``applyInPandas`` fit and Pandas UDF scoring)
    unpickle functions and the broadcast model by module reference, so the
    executors need the package. A cluster would install it or pass it with
    ``--py-files`` and set ``spark.ledgerlens.shipPackage=false``; otherwise
    this ships a zip of the package once per application (Spark serves it to
    the executors from the driver), so that it also works when neither was
    done.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or spark.conf.get("spark.ledgerlens.shipPackage", "true").lower() == "false":
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-pyfiles-"), "ledgerlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def configured_checkpoint_dir(spark: SparkSession) -> str | None:
    """The reliable (shared) checkpoint folder the session names, if any."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return None


_TABLES: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, as_table: bool = False) -> DataFrame:
    """Cut the lineage of a frame that later passes read several times.

    With a reliable checkpoint folder configured, the frame is written there,
    so a lost executor costs a re-read, not a recompute: as a Parquet table
    (``as_table``: later passes read only the columns they use and can skip
    row groups by their statistics; ``drop_materialized`` removes it) or with
    ``checkpoint``. A write that fails is an error. Without a folder the frame
    is persisted (memory, spilling to disk) and a lost block is recomputed from
    its deterministic lineage. The library never makes a machine-local folder
    for this.
    """
    spark = df.sparkSession
    folder = configured_checkpoint_dir(spark)
    if folder:
        if as_table:
            import uuid
            path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
            df.write.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
            _TABLES[id(out)] = (out, path)
            return out
        return df.checkpoint(eager=True)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def drop_materialized(df: DataFrame) -> None:
    """Remove what ``materialize`` made, once nothing reads it any more."""
    _, path = _TABLES.pop(id(df), (None, None))
    if path is None:
        df.unpersist()
        return
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as
    given, and without one this is an error there. Only in local mode, where
    driver and executors are one process, is a fresh folder made.
    """
    folder = configured_checkpoint_dir(spark)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-ckpt-"))
    return sc.getCheckpointDir()


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
