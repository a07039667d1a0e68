"""Isolation forest (Liu, Ting & Zhou, ICDM 2008) as Spark jobs.

Fit
  1. Subsample: every row has one hash h of (id, seed); tree t draws the
     ``psi = min(max_samples, n)`` rows with the smallest ``draw(h, t)``, a cheap
     integer mix, of equal draws the smaller id. A cut-off a few standard
     deviations above the expected psi-th draw is applied where the rows are
     read, so only a few rows a tree are shuffled; if a tree got too few, the
     cut-off is raised. Every table size takes this path.
  2. ``groupBy(tree).applyInArrow``: one tree per group of ``psi`` rows. The
     split feature and threshold of a node are draws of (seed, tree, node), so
     the forest does not depend on partitioning or row order.
  3. The model (at most ``trees * (2 * psi - 1)`` nodes whatever the data; a
     fit beyond ``MOST_NODES`` is refused) is collected and broadcast.
Score
  A scalar Pandas UDF walks all trees at once over Arrow batches:
  ``score_samples = -2 ** (-mean path length / c(psi))`` where a leaf adds
  ``c(leaf size)`` (path lengths are added up in units of 1e-9, exactly); the
  cut-off is the ``contamination`` percentile of ``score_samples`` (exact,
  distributed), ``decision = score_samples - offset``, ``anomaly_score =
  -decision`` and ``is_anomaly = decision < 0``. With one row, c(psi) is 0 and
  every score is -0.5: nothing is flagged.
Split rule
  A random feature among those not constant in the node, a threshold uniform
  in [min, max) of it (the max maps back to the min), left when ``x <= t``.
  Growth stops at depth ``ceil(log2 psi)``, at one row, or when every
  feature is constant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_materialized, materialize, ship_package
from .quantile import exact_percentile, sample_hash

EULER_GAMMA = 0.5772156649015329

# Nodes of a model that may be collected and broadcast (about 30 bytes each).
MOST_NODES = 5_000_000
# Draws are linear congruences modulo this prime (2**31 - 1); a twin in SQL can repeat them.
PRIME = 2_147_483_647

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
])


def draw(x, k):
    """A number below ``PRIME`` from a number and a stream, for ints and int64 arrays
    (all products stay below 2**63)."""
    a = (k * 48271 + 11) % PRIME + 1
    y = ((x % PRIME) * a + 12345 + k) % PRIME
    return ((y ^ (y >> 15)) * 16807 + k) % PRIME


def average_path_length(n) -> np.ndarray:
    """c(n): mean path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_tree(x: np.ndarray, seed: int, tree: int, max_depth: int) -> list[tuple]:
    """Nodes (node_id, feature, threshold, size, depth) of one tree; the children
    of node i are 2i (left) and 2i + 1, the root is 1."""
    nodes: list[tuple] = []
    stack = [(np.arange(len(x)), 0, 1)]
    while stack:
        idx, depth, node = stack.pop()
        xs = x[idx]
        lo, hi = xs.min(axis=0), xs.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(idx) <= 1 or usable.size == 0:
            nodes.append((node, -1, 0.0, len(idx), depth))
            continue
        first = draw(seed * 1000003 + tree, 1) * 1024 + node
        f = int(usable[draw(first, 2) % usable.size])
        t = float(lo[f] + (draw(first, 3) / PRIME) * (hi[f] - lo[f]))
        if t >= hi[f]:
            t = float(lo[f])
        nodes.append((node, f, t, len(idx), depth))
        go_left = xs[:, f] <= t
        stack.append((idx[~go_left], depth + 1, 2 * node + 1))
        stack.append((idx[go_left], depth + 1, 2 * node))
    return nodes


def _fit_group(features: list[str], seed: int, max_depth: int, psi: int):
    def fit(key, table):
        table = _first(table, psi)
        x = np.column_stack([table[f].to_numpy() for f in features])
        tree = key[0].as_py()
        nodes = list(zip(*grow_tree(x, seed, tree, max_depth)))
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
        return pa.table([pa.array([tree] * len(nodes[0]), pa.int32()), *(pa.array(c, k) for c, k in zip(nodes, kinds))],
                        names=NODE_SCHEMA.fieldNames())
    return fit


PATH_UNITS = 1_000_000_000


@dataclass
class IsolationForestModel:
    """All trees as one table. A walk needs no test for leaves: ``steps`` holds, for
    each tree, a full binary tree of depth ``max_depth`` in which a leaf sends every
    row on to the left, and ``ends`` the path lengths of its lowest level. That is
    at most four places for every sampled row."""
    feature: np.ndarray     # per node, -1 for a leaf
    threshold: np.ndarray
    left: np.ndarray        # global node index
    right: np.ndarray
    path: np.ndarray        # depth + c(size) for leaves, in units of 1 / PATH_UNITS
    roots: np.ndarray       # global index of each tree's root
    max_depth: int
    psi: int
    n_features: int
    step_feature: np.ndarray
    step_threshold: np.ndarray
    ends: np.ndarray

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, psi: int, max_depth: int, n_features: int) -> "IsolationForestModel":
        nodes = nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
        tree, node = nodes["tree_id"].to_numpy(np.int64), nodes["node_id"].to_numpy(np.int64)
        key = (tree << 40) | node
        inner = nodes["feature"].to_numpy() >= 0
        at = lambda child: np.where(inner, np.searchsorted(key, (tree << 40) | child), -1)
        depth = nodes["depth"].to_numpy(np.int64)
        units = depth * PATH_UNITS + np.rint(average_path_length(nodes["size"].to_numpy()) * PATH_UNITS).astype(np.int64)
        feature, threshold = nodes["feature"].to_numpy().astype(np.int64), nodes["threshold"].to_numpy(np.float64)
        roots = np.flatnonzero(node == 1)
        width, place = 1 << max_depth, np.cumsum(node == 1) - 1
        steps_f, steps_t = np.zeros(len(roots) * width, np.int32), np.full(len(roots) * width, np.inf)
        ends = np.zeros(len(roots) * width, np.int64)
        steps_f[(place * width + node)[inner]], steps_t[(place * width + node)[inner]] = feature[inner], threshold[inner]
        leaf = ~inner
        ends[(place * width + ((node << (max_depth - depth)) - width))[leaf]] = units[leaf]
        return cls(feature, threshold, at(2 * node), at(2 * node + 1), units, roots, max_depth, psi, n_features,
                   steps_f, steps_t, ends)

    def score_samples(self, x: np.ndarray, chunk: int = 16384) -> np.ndarray:
        """-2 ** (-E[h(x)] / c(psi)) for each row of ``x`` (rows × features).

        ``chunk`` rows at a time are walked through one tree after the other: a
        tree's steps and the chunk's few arrays stay in the processor's cache, and
        working memory is bounded whatever the Arrow batch size.
        """
        scale = float(average_path_length([self.psi])[0])
        trees = len(self.roots)
        if trees == 0 or scale == 0.0:
            return np.full(len(x), -0.5)
        if len(x) > chunk:
            return np.concatenate([self.score_samples(x[i:i + chunk], chunk) for i in range(0, len(x), chunk)])
        n, width = len(x), 1 << self.max_depth
        # One feature after the other; a missing comparison goes right, as a large value does.
        flat = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x).T).ravel()
        column = self.step_feature.astype(np.intp).reshape(trees, width) * n
        threshold, ends = self.step_threshold.reshape(trees, width), self.ends.reshape(trees, width)
        row = np.arange(n, dtype=np.intp)
        at, value, limit, right = np.empty(n, np.intp), np.empty(n), np.empty(n), np.empty(n, bool)
        total, found = np.zeros(n, np.int64), np.empty(n, np.int64)
        for tree in range(trees):
            node = np.ones(n, np.intp)
            for _ in range(self.max_depth):
                # Every index is in range; "clip" only spares the copies that checking takes.
                np.take(column[tree], node, out=at, mode="clip")
                np.take(threshold[tree], node, out=limit, mode="clip")
                at += row
                np.take(flat, at, out=value, mode="clip")
                np.greater(value, limit, out=right)
                node += node
                node += right
            node -= width
            total += np.take(ends[tree], node, out=found, mode="clip")
        return -np.power(2.0, -(total / (PATH_UNITS * trees)) / scale)


def _features_frame(df: DataFrame, id_col: str, features: list[str], seed: int) -> DataFrame:
    """The id, its hash and the features as doubles, nulls as 0."""
    return df.select(F.col(id_col).alias("_id"), F.coalesce(sample_hash(id_col, seed), F.lit(0)).alias("_h"),
                     *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])


def _first(table: pa.Table, psi: int) -> pa.Table:
    return table.sort_by([("draw", "ascending"), ("_id", "ascending")]).slice(0, psi)


def _tree_candidates(x: DataFrame, features: list[str], n: int, psi: int, n_trees: int) -> tuple[DataFrame, DataFrame]:
    """(tree_id, draw, _id, features) by tree, with the ``psi`` rows of each tree and a few more, and what is cached."""
    id_type = x.schema["_id"].dataType.simpleString()
    schema = f"tree_id int, draw long, _id {id_type}, " + ", ".join(f"`{f}` double" for f in features)

    def candidates(cut: int):
        def run(batches):
            for batch in batches:
                h = batch.column(1).to_numpy(zero_copy_only=False)
                found = []
                for t in range(n_trees):
                    d = draw(h, t)
                    at = np.flatnonzero(d <= cut)
                    found.append((np.full(len(at), t, np.int32), d[at], at))
                tree, drawn, at = (np.concatenate(c) for c in zip(*found))
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(drawn), rows.column(0), *rows.columns[2:]],
                                                 names=["tree_id", "draw", "_id", *features])
        return x.mapInArrow(run, schema)

    slack = 8.0 * math.sqrt(psi) + 64.0
    while True:
        cut = min(PRIME, int((psi + slack) / n * PRIME))
        cand = candidates(cut).persist(StorageLevel.MEMORY_AND_DISK)
        counts = [r["count"] for r in cand.groupBy("tree_id").count().collect()]   # one row a tree
        if cut >= PRIME or (len(counts) == n_trees and min(counts) >= psi):
            # Growing trees is CPU work: an explicit number of partitions is not coalesced.
            parts = max(1, min(n_trees, x.sparkSession.sparkContext.defaultParallelism * 2))
            return cand.repartition(parts, "tree_id"), cand
        cand.unpersist()
        slack *= 4


def _tree_samples(x: DataFrame, features: list[str], n: int, psi: int, n_trees: int) -> tuple[DataFrame, DataFrame]:
    """(tree_id, draw, _id, features) with exactly ``psi`` rows a tree, and what is cached."""
    cand, held = _tree_candidates(x, features, n, psi, n_trees)
    return cand.groupBy("tree_id").applyInArrow(lambda key, table: _first(table, psi), cand.schema), held


def fit(df: DataFrame, id_col: str, features: list[str], n_trees: int = 150, max_samples: int = 256,
        seed: int = 42) -> IsolationForestModel:
    """Fit on the id and feature columns of ``df`` (nulls as 0)."""
    x = _features_frame(df, id_col, features, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_features(x, features, x.count(), n_trees, max_samples, seed)
    finally:
        x.unpersist()


def depth_for(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


def fit_nodes(x: DataFrame, features: list[str], n: int, n_trees: int = 150, max_samples: int = 256,
              seed: int = 42) -> tuple[pd.DataFrame, int]:
    """The nodes of a forest over a frame of ``_id``, ``_h`` and the features (already
    null-filled) with ``n`` rows, and the rows a tree."""
    ship_package(x.sparkSession)
    psi = max(1, min(max_samples, n))
    if n_trees * (2 * psi - 1) > MOST_NODES:
        raise ValueError(f"{n_trees} trees of {psi} rows may have more than {MOST_NODES} nodes")
    if n == 0:
        return pd.DataFrame(columns=NODE_SCHEMA.fieldNames()), psi
    sample, held = _tree_candidates(x, features, n, psi, n_trees)
    try:
        # At most MOST_NODES rows.
        grown = sample.groupBy("tree_id").applyInArrow(_fit_group(features, seed, depth_for(psi), psi), NODE_SCHEMA)
        return grown.toPandas(), psi
    finally:
        held.unpersist()


def fit_features(x: DataFrame, features: list[str], n: int, n_trees: int = 150, max_samples: int = 256,
                 seed: int = 42) -> IsolationForestModel:
    """Fit on a frame of ``_id``, ``_h`` and the features (already null-filled) with ``n`` rows."""
    nodes, psi = fit_nodes(x, features, n, n_trees, max_samples, seed)
    return IsolationForestModel.from_nodes(nodes, psi, depth_for(psi), len(features))


def score_column(model: IsolationForestModel, features: list[str], spark) -> Column:
    """``score_samples`` of each row as a vectorised Pandas UDF over Arrow batches."""
    ship_package(spark)
    bc = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64, na_value=0.0) for c in cols])
        return pd.Series(bc.value.score_samples(x))

    return score(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])


def isolation_forest_scores(df: DataFrame, id_col: str, features: list[str], contamination: float = 0.02,
                            n_trees: int = 150, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """``df`` plus ``anomaly_score`` (higher is more anomalous) and ``is_anomaly``.

    Only the id, its hash and the features are persisted for the fit. The
    cut-off search reads a table of the scores alone (one column, in the
    session's checkpoint folder, removed when the cut-off is known); the rows
    returned are scored where they are read, so no other column is rewritten.
    """
    x = _features_frame(df, id_col, features, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = x.count()
        model = fit_features(x, features, n, n_trees, max_samples, seed)
        score = score_column(model, features, df.sparkSession)
        scores = materialize(x.select(score.alias("_ss")), as_table=True)
        try:
            offset = exact_percentile(scores, "_ss", contamination, n=n) or 0.0
        finally:
            drop_materialized(scores)
    finally:
        x.unpersist()
    decision = F.col("_ss") - F.lit(float(offset))
    keep = [F.col(c) for c in df.columns]
    return df.withColumn("_ss", score).select(
        *keep, (-decision).alias("anomaly_score"), (decision < 0).alias("is_anomaly"))
