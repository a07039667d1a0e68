"""A stored isolation forest: fitted once, asked for any sensitivity.

A store is a folder (of any file system that Spark writes to) with

- ``nodes/<id>``: the model, a Parquet table with a row a tree node;
- ``scores/<id>``: the score of every row it was fitted on or has taken in since,
  one column, sorted within files so that a range of scores skips row groups;
- ``sketch/<id>``: how many scores fall into each of ``BUCKETS`` equal buckets of
  [-1, 0], with the least and the largest. Sketches add up by bucket, so those of
  several parts are merged where they are read;
- ``parts``: one row a finished part, appended last, with the fit's parameters and
  the fingerprint of its input. What no part names is not there.

The cut-off for a contamination is the exact percentile of the scores: the sketch
says which bucket holds the rank and the bucket's values are selected from
(``quantile.select_ranks``), so another contamination costs one selection and
neither a fit nor any scoring. Results are scored where rows are read.

``stored_forest`` finds the store of a table by parameters and fingerprint (one
pass over id and features; independent of the order and partitioning of rows).
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configured_checkpoint_dir, ensure_checkpoint_dir
from . import iforest
from .quantile import _lerp, select_ranks

BUCKETS = 1 << 14
PARTS = "part string, name string, meta string"
SKETCH = "bucket int, n long, lo double, hi double"


def fingerprint(x: DataFrame) -> tuple[str, int]:
    """A fingerprint of a frame's rows, and their number; the order of rows and partitions does not show."""
    h = F.xxhash64(*x.columns)
    one = x.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()
    return hashlib.md5(f"{','.join(x.columns)}:{one['n']}:{one['x']}:{one['s']}".encode()).hexdigest(), one["n"]


def sketch_of(scores: DataFrame) -> DataFrame:
    """(bucket, n, lo, hi) of a column ``_ss`` of scores in [-1, 0]."""
    bucket = F.least(F.floor((F.col("_ss") + 1.0) * float(BUCKETS)), F.lit(BUCKETS - 1)).cast("int")
    return scores.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("_ss").alias("lo"), F.max("_ss").alias("hi"))


def merged(sketches: DataFrame) -> DataFrame:
    """One sketch of all rows that the given ones cover."""
    return sketches.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class StoredForest:
    """A forest in a store; ``fit`` makes one, ``load`` opens one."""

    def __init__(self, spark: SparkSession, folder: str, parts: list):
        self.spark, self.folder = spark, folder
        self.parts = [r["part"] for r in parts]
        self.names = {r["name"] for r in parts if r["name"] is not None}
        self.meta = next(json.loads(r["meta"]) for r in parts if r["meta"])

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "StoredForest | None":
        """The forest in a folder; none where no fit has been finished."""
        folder = folder.rstrip("/")
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/parts")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        rows = spark.read.schema(PARTS).parquet(f"{folder}/parts").collect()       # one row a part
        # Fits that ran at the same time are equal; the parts of one of them count.
        fits = sorted(r["part"] for r in rows if r["meta"])
        return cls(spark, folder, [r for r in rows if not r["meta"] or r["part"] == fits[0]]) if fits else None

    @classmethod
    def fit(cls, df: DataFrame, id_col: str, features: list[str], folder: str, n_trees: int = 150, max_samples: int = 256,
            seed: int = 42) -> "StoredForest":
        """Fit on ``df`` and store model, scores and sketch."""
        x = iforest._features_frame(df, id_col, features, seed).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return cls._fit(x, folder, features, *fingerprint(x), n_trees, max_samples, seed)
        finally:
            x.unpersist()

    @classmethod
    def _fit(cls, x: DataFrame, folder: str, features: list[str], found: str, n: int, n_trees: int, max_samples: int,
             seed: int) -> "StoredForest":
        spark, part = x.sparkSession, uuid.uuid4().hex
        folder = folder.rstrip("/")
        nodes, psi = iforest.fit_nodes(x, features, n, n_trees, max_samples, seed)
        spark.createDataFrame(nodes, iforest.NODE_SCHEMA).coalesce(1).write.parquet(f"{folder}/nodes/{part}")
        model = iforest.IsolationForestModel.from_nodes(nodes, psi, iforest.depth_for(psi), len(features))
        meta = {"features": features, "n_trees": n_trees, "max_samples": max_samples, "seed": seed, "psi": psi, "rows": n,
                "fingerprint": found}
        cls._write(x, model, features, folder, part, None, json.dumps(meta))
        return cls.load(spark, folder)

    @staticmethod
    def _write(rows: DataFrame, model, features: list[str], folder: str, part: str, name: str | None, meta: str | None) -> None:
        spark = rows.sparkSession
        scores = rows.select(iforest.score_column(model, features, spark).alias("_ss"))
        scores.sortWithinPartitions("_ss").write.parquet(f"{folder}/scores/{part}")
        written = spark.read.schema("_ss double").parquet(f"{folder}/scores/{part}")
        sketch_of(written).coalesce(1).write.parquet(f"{folder}/sketch/{part}")
        spark.createDataFrame([(part, name, meta)], PARTS).coalesce(1).write.mode("append").parquet(f"{folder}/parts")

    def absorb(self, name: str, df: DataFrame) -> bool:
        """Take in the scores of further rows, so that cut-offs cover them too; false if a part of that name is in already."""
        if name in self.names:
            return False
        self._write(df, self.model, self.meta["features"], self.folder, uuid.uuid4().hex, name, None)
        now = StoredForest.load(self.spark, self.folder)
        self.parts, self.names = now.parts, now.names
        self.__dict__.pop("sketch", None)
        return True

    @cached_property
    def model(self) -> iforest.IsolationForestModel:
        fitted = min(p for p in self.parts if self._has(f"nodes/{p}"))
        nodes = self.spark.read.schema(iforest.NODE_SCHEMA).parquet(f"{self.folder}/nodes/{fitted}").toPandas()
        return iforest.IsolationForestModel.from_nodes(nodes, self.meta["psi"], iforest.depth_for(self.meta["psi"]),
                                                       len(self.meta["features"]))

    def _has(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _paths(self, kind: str) -> list[str]:
        return [f"{self.folder}/{kind}/{p}" for p in self.parts]

    @cached_property
    def sketch(self) -> list:
        """The merged sketch, ``BUCKETS`` rows at most, by bucket."""
        return merged(self.spark.read.schema(SKETCH).parquet(*self._paths("sketch"))).orderBy("bucket").collect()

    def score_range(self) -> tuple[float, float]:
        """The least and the largest score (0, 0 without rows)."""
        return (self.sketch[0]["lo"], self.sketch[-1]["hi"]) if self.sketch else (0.0, 0.0)

    def offset(self, contamination: float) -> float:
        """The ``contamination`` percentile of all scores (linear interpolation); 0 without rows."""
        n = sum(r["n"] for r in self.sketch)
        if n == 0:
            return 0.0
        pos = contamination * (n - 1)
        k = int(math.floor(pos))
        value, below = {}, 0
        for r in self.sketch:
            inside = [i for i in {k, min(k + 1, n - 1)} if below <= i < below + r["n"]]
            if inside and r["lo"] == r["hi"]:
                value.update({i: r["lo"] for i in inside})
            elif inside:
                held = self.spark.read.schema("_ss double").parquet(*self._paths("scores")).where(
                    F.col("_ss").between(F.lit(r["lo"]), F.lit(r["hi"])))
                got = select_ranks(held, "_ss", [i - below for i in inside], known=(r["n"], r["lo"], r["hi"]))
                value.update({i + below: v for i, v in got.items()})
            below += r["n"]
        return _lerp(value[k], value[min(k + 1, n - 1)], pos - k)

    def scored(self, df: DataFrame, contamination: float) -> DataFrame:
        """``df`` plus ``anomaly_score`` and ``is_anomaly``, scored where it is read."""
        decision = F.col("_ss") - F.lit(self.offset(contamination))
        score = iforest.score_column(self.model, self.meta["features"], df.sparkSession)
        return df.withColumn("_ss", score).select(
            *[F.col(c) for c in df.columns], (-decision).alias("anomaly_score"), (decision < 0).alias("is_anomaly"))

    def anomaly_range(self, contamination: float) -> tuple[float, float]:
        """The least and the largest ``anomaly_score``."""
        lo, hi = self.score_range()
        offset = self.offset(contamination)
        return -(hi - offset), -(lo - offset)


def stored_forest(df: DataFrame, id_col: str, features: list[str], n_trees: int = 150, max_samples: int = 256, seed: int = 42,
                  folder: str | None = None) -> StoredForest:
    """The forest of a table, fitted if no store has one of these rows and parameters.
    Stores lie in ``folder``, by default in the session's checkpoint folder."""
    spark = df.sparkSession
    base = folder or configured_checkpoint_dir(spark) or ensure_checkpoint_dir(spark)
    x = iforest._features_frame(df, id_col, features, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found, n = fingerprint(x)
        key = hashlib.md5(json.dumps([found, features, n_trees, max_samples, seed]).encode()).hexdigest()
        where = f"{base.rstrip('/')}/forests/{key}"
        return StoredForest.load(spark, where) or StoredForest._fit(x, where, features, found, n, n_trees, max_samples, seed)
    finally:
        x.unpersist()
