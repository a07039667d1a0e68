"""Counting hashes over the whole corpus by asking and answering.

A batch of documents lists its distinct 64-bit hashes in ascending order and
sends contiguous ranges of the list to the bins of the hash space (``messages``);
a bin adds up the counts of equal hashes and answers each message with the
totals, in its order (``answer``); put together by bin, the answers stand in the
order of the batch's list (``totals``). A hash costs one entry a batch, however
often it occurs, and no part of the corpus is ever held as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "batch long, bin int, hashes binary, counts binary"
ANSWER = "batch long, bin int, counts binary"
BATCH_BYTES = 8 << 20


def number_of_batches(docs: DataFrame, text: str, parts: int) -> int:
    """How many batches of about ``BATCH_BYTES`` the texts make, one a partition at least."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(parts, -(-size // BATCH_BYTES))


def bin_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Integers by byte planes: the mostly equal high bytes lie together, so that Spark's shuffle compresses them away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(packed: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def steps(hashes: np.ndarray) -> bytes:
    """Ascending hashes as their differences."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def from_steps(packed: bytes) -> np.ndarray:
    return np.cumsum(from_planes(packed, np.uint64), dtype=np.uint64)


def messages(batch: int, listed: np.ndarray, count: np.ndarray, bins: int) -> pa.Table:
    where = bin_of(listed, bins)
    cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.zeros(0, np.int64)
    stop = np.r_[cut[1:], len(where)]
    return pa.table({"batch": pa.array([batch] * len(cut), pa.int64()), "bin": pa.array(where[cut], pa.int32()),
                     "hashes": pa.array([steps(listed[a:b]) for a, b in zip(cut, stop)], pa.binary()),
                     "counts": pa.array([planes(count[a:b].astype(np.uint32)) for a, b in zip(cut, stop)],
                                        pa.binary())})


def sums(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Per message of one bin the totals of its hashes, in its order; and the total of each distinct hash."""
    hashes = [from_steps(h) for h in table["hashes"].to_pylist()]
    counts = np.concatenate([from_planes(c, np.uint32) for c in table["counts"].to_pylist()]).astype(np.int64)
    both = np.concatenate(hashes)
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    out = np.empty(len(both), np.int64)
    out[order] = total[np.cumsum(new) - 1]
    return np.split(out, np.cumsum([len(h) for h in hashes])[:-1]), total


def answer(key, table):
    per_message, _ = sums(table)
    return pa.table({"batch": table["batch"], "bin": table["bin"],
                     "counts": pa.array([planes(t.astype(np.uint64)) for t in per_message], pa.binary())})


def answers(asked: DataFrame, parts: int) -> DataFrame:
    return asked.repartition(parts, "bin").groupBy("bin").applyInArrow(answer, ANSWER)


def totals(table: pa.Table) -> np.ndarray:
    """The answers to one batch, in the order of its list."""
    parts = table["counts"].to_pylist()
    order = np.argsort(np.asarray(table["bin"]))
    return np.concatenate([from_planes(parts[i], np.uint64) for i in order] or [np.zeros(0, np.uint64)])
