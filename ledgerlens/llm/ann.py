"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stopping test.

Vectors are scaled to length 1 (then the largest cosine is the smallest
distance) and projected to ``PROJECTED`` dimensions with Gaussian (2-stable)
directions, so that for two vectors at distance d the squared projected
distance divided by d^2 follows a chi-square law with that many degrees of
freedom. A query takes its projected neighbours in order of distance and
verifies them on the original vectors, until the next one is so far that a
vector nearer than the k-th best found would be projected that far with
probability ``1 - SURE`` at most.

On Spark: the top of the kd-tree, fitted on a bounded sample of projections,
deals all rows into cells; cells with many rows are split into blocks of
about ``BLOCK`` rows, and their queries into groups, so no task holds more than
a block and a query group. Each block has its own kd-tree. A query first
searches its own cell, which bounds its k-th distance, then only the cells that
the test does not rule out.

Equal vectors count once: a class of equal vectors is searched for once and is
present with its k + 1 smallest ids only, which is all that any result can
hold. Final scores are cosines of the original vectors in double precision.

Rows: an id or vector that is null, a vector that is zero or holds null or
non-finite components, and vectors of another length than the most common one
(of equals the longer) take no part; of rows that repeat an id the smallest
vector counts. Ties go to the smaller id. Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .text import partitions, read_table

PROJECTED = 8
SURE = 0.98
BLOCK = 4096
QUERY_GROUP = 1024
SAMPLE = 20_000
MOST_CELLS = 4096
LEAF = 64
SLACK = 1e-9


def chi_square_quantile(p: float, freedom: int) -> float:
    """The x with P(chi-square <= x) = p, for an even number of degrees of freedom."""
    half = freedom // 2

    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))

    lo, hi = 0.0, 10.0 * freedom + 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(dim: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, PROJECTED))


def to_unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the row of ``b``; the order of additions depends on the values' places only."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class KdTree:
    """A complete kd-tree: splits on the widest side at the median, ``2 ** depth`` leaves with their boxes."""

    def __init__(self, points: np.ndarray, depth: int):
        n = 2 ** depth
        self.depth = depth
        self.side, self.at = np.zeros(max(1, n - 1), np.int64), np.zeros(max(1, n - 1))
        self.low, self.high = np.full((n, points.shape[1]), -np.inf), np.full((n, points.shape[1]), np.inf)
        self.leaves: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self._split(points, np.arange(len(points)), 0, 0, n)

    def _split(self, points, rows, node, first, last):
        if last - first == 1:
            self.leaves[first] = rows
            return
        own = points[rows]
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(rows) else 0
        at = float(np.median(own[:, side])) if len(rows) else 0.0
        self.side[node], self.at[node] = side, at
        mid = (first + last) // 2
        self.high[first:mid, side] = np.minimum(self.high[first:mid, side], at)
        self.low[mid:last, side] = np.maximum(self.low[mid:last, side], at)
        right = own[:, side] > at
        self._split(points, rows[~right], 2 * node + 1, first, mid)
        self._split(points, rows[right], 2 * node + 2, mid, last)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.side[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node - (2 ** self.depth - 1)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def search_block(unit: np.ndarray, projected: np.ndarray, ids: np.ndarray, q_unit: np.ndarray, q_projected: np.ndarray,
                 bound: np.ndarray, k: int, quantile: float) -> list[np.ndarray]:
    """For each query the rows of the block that may be among its k nearest.
    ``bound``: squared distance of its k-th best so far (4: none known)."""
    tree = KdTree(projected, max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF))))
    place = np.concatenate(tree.leaves)                 # rows leaf by leaf
    size = np.array([len(x) for x in tree.leaves])
    start = np.cumsum(size) - size
    unit, projected = unit[place], projected[place]
    out = []
    for u, p, limit in zip(q_unit, q_projected, bound):
        box = tree.distances(p)
        order = np.argsort(box, kind="stable")
        rows, near = [], []
        at, step = 0, 1
        while at < len(order):
            # The next leaves in order of distance, ever more at a time, as far as the test allows.
            leaves = order[at:at + step]
            at, step = at + step, 2 * step
            leaves = leaves[box[leaves] <= quantile * limit + SLACK]
            if len(leaves) == 0:
                break
            n = size[leaves]
            new = np.arange(n.sum()) + np.repeat(start[leaves] - (np.cumsum(n) - n), n)
            gap = projected[new] - p
            new = new[np.einsum("ij,ij->i", gap, gap) <= quantile * limit + SLACK]
            rows.append(new)
            near.append(2 - 2 * (unit[new] @ u))
            every = np.concatenate(near)
            if len(every) >= k:
                limit = min(limit, max(0.0, float(np.partition(every, k - 1)[k - 1])))
        every = np.concatenate(near or [np.zeros(0)])
        out.append(place[np.concatenate(rows or [np.zeros(0, np.int64)])[every <= limit + SLACK]])
    return out


def usable(df: DataFrame, id_column: str, vector: str, dim: int | None) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, one an id, and the vectors' length."""
    v = F.col(vector).cast("array<double>")
    rows = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), v.alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    if dim is None:
        common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = common["dim"] if common else 0
    return rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), dim


def nearest(df: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5,
            sure: float = SURE, dim: int | None = None) -> DataFrame:
    """(query_id, rank, <id>, score): for each row for which ``is_query`` (an
    expression of a column ``id``) holds, the ``k`` nearest other rows."""
    spark = df.sparkSession
    ship_package(spark)
    parts = partitions(df)
    rows, dim = usable(df, id_column, vector, dim)
    rows = materialize(rows, as_table=True)
    held = k + 1                                        # a query may find itself
    axes, quantile = directions(dim), chi_square_quantile(sure, PROJECTED)
    in_class = W.partitionBy("v").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(in_class)).where(F.col("n") <= held).select("id", "v")
    asked = rows.where(is_query)
    keys = asked.groupBy("v").agg(F.min("id").alias("q"))

    def flat(column):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def project(batches):
        for batch in batches:
            p = to_unit(flat(batch.column(1))) @ axes
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.tolist(), pa.list_(pa.float64()))], names=["p"])

    count = kept.count()
    depth = max(0, min(math.ceil(math.log2(max(1, count) / BLOCK)), int(math.log2(MOST_CELLS))))
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInArrow(project, "p array<double>").collect()
    tree = KdTree(np.array([r.p for r in sample]).reshape(-1, PROJECTED), depth)

    def place(batches):
        for batch in batches:
            v = flat(batch.column(1))
            cell = tree.leaf_of(to_unit(v) @ axes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32())],
                                             names=["id", "v", "cell"])

    placed = materialize(kept.mapInArrow(place, "id long, v array<double>, cell int"), as_table=True)
    # One row a cell, at most MOST_CELLS.
    blocks = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))

    def search(key, table, queries):
        if table.num_rows == 0 or queries.num_rows == 0:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        v, qv = flat(table["v"].combine_chunks()), flat(queries["v"].combine_chunks())
        ids, q = np.asarray(table["id"]), np.asarray(queries["q"])
        u, qu = to_unit(v), to_unit(qv)
        found = search_block(u, u @ axes, ids, qu, qu @ axes, np.asarray(queries["bound"]), held, quantile)
        at = np.repeat(np.arange(len(q)), [len(f) for f in found])
        hit = np.concatenate(found).astype(np.int64)
        score = cosines(qv[at], v[hit])
        order = np.lexsort((ids[hit], -score, at))
        rank = np.arange(len(at)) - np.searchsorted(at[order], at[order], "left")
        order = order[rank < held]
        return pa.table({"q": q[at[order]], "id": ids[hit[order]], "score": score[order]})

    def found_in(queries):
        """Search of (q, v, bound, cell) rows, each in all blocks of its cell; groups of queries are bounded too."""
        groups = F.broadcast(queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_GROUP).alias("groups")))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        data = placed.join(blocks, "cell").join(groups, "cell").select(
            "cell", "id", "v", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), upto("groups").alias("part"))
        many = queries.join(blocks, "cell").join(groups, "cell").select(
            "cell", "q", "v", "bound", F.pmod(F.xxhash64("q"), F.col("groups")).alias("part"), upto("blocks").alias("block"))
        return data.groupBy("cell", "block", "part").cogroup(many.groupBy("cell", "block", "part")).applyInArrow(
            search, "q long, id long, score double")

    def best(found):
        order = W.partitionBy("q").orderBy(F.desc("score"), "id")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= held)

    home = keys.select(F.col("q").alias("id"), "v").mapInArrow(place, "id long, v array<double>, cell int").select(
        F.col("id").alias("q"), "v", F.lit(4.0).alias("bound"), "cell")
    home = materialize(home, as_table=True)
    first = materialize(best(found_in(home)).drop("n"), as_table=True)
    known = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    bounded = home.select("q", "v", "cell").join(known, "q", "left").select(
        "q", "v", "cell", F.when(F.col("n") >= held, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))).otherwise(4.0).alias("bound"))

    def route(batches):
        for batch in batches:
            p = to_unit(flat(batch.column(1))) @ axes
            own, bound = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            at, cells = [], []
            for i in range(len(p)):
                open_ = np.flatnonzero(tree.distances(p[i]) <= quantile * bound[i] + SLACK)
                open_ = open_[open_ != own[i]]
                at.append(np.full(len(open_), i))
                cells.append(open_)
            at = pa.array(np.concatenate(at or [np.zeros(0, int)]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at),
                 pa.array(np.concatenate(cells or [np.zeros(0, int)]), pa.int32())], names=["q", "v", "bound", "cell"])

    onward = materialize(bounded.mapInArrow(route, "q long, v array<double>, bound double, cell int"), as_table=True)
    result = best(first.union(found_in(onward))).drop("n")
    members = asked.join(keys, "v").select(F.col("id").alias("query_id"), "q")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (members.join(result, "q").where("id <> query_id").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose vec_id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
