"""Vectorised words, word hashes and n-gram hashes over Arrow string columns.

Everything here works inside a task on one Arrow batch: numpy over the UTF-8
bytes, no Python object per word. Word hashes are 64-bit polynomials over
random byte values, taken for all words at once from running sums, then
mixed; n-gram hashes are polynomials over the word hashes. Spark partitions
and shuffles whatever these helpers produce.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The bytes that separate words (space and \t \n \v \f \r).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SEPARATORS)] = True

_U = np.uint64
_BLOCK = 1 << 18                      # bytes hashed at a time
_BYTE_STEP = 0x9E3779B97F4A7C15       # odd, so powers have inverses modulo 2**64
_WORD_STEP = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _powers(step: int, n: int) -> np.ndarray:
    out = np.full(n, step, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Steps:
    """Powers of an odd step and of its inverse, grown on demand."""

    def __init__(self, step: int):
        self.step, self.inverse, self.n = step, pow(step, -1, 1 << 64), 0

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, _BLOCK + 1)
            self.up, self.down = _powers(self.step, self.n), _powers(self.inverse, self.n)
        return self.up, self.down


_bytes_steps, _word_steps = _Steps(_BYTE_STEP), _Steps(_WORD_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_values(lower: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower``, A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(0x632BE59BD9B4E019) + _U(seed * 0x1000003))
    if lower:
        table[65:91] = table[97:123]
    return table


@dataclass
class Words:
    """The words of consecutive texts: byte ranges, and text ``i`` has words ``first[i]:first[i + 1]``."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Index of the text that holds each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(raw: np.ndarray, at: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separator; a text's end ends a word."""
    n = len(at) - 1
    if len(raw) == 0:
        return Words(raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    space = _IS_SPACE[raw]
    opens = ~space
    closes = opens.copy()
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[edge] = True
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[edge - 1] = True
    opens &= before
    closes &= after
    start = np.flatnonzero(opens)
    return Words(raw, start, np.flatnonzero(closes) + 1, np.searchsorted(start, at))


def word_hashes(words: Words, values: np.ndarray) -> np.ndarray:
    """One mixed 64-bit hash per word."""
    n = len(words)
    out = np.empty(n, _U)
    a = 0
    while a < n:
        base = words.start[a]
        b = max(a + 1, int(np.searchsorted(words.end, base + _BLOCK, "right")))
        stop = words.end[b - 1]
        up, down = _bytes_steps(int(stop - base))
        run = np.zeros(stop - base + 1, _U)
        np.cumsum(values[words.data[base:stop]] * up[:stop - base], out=run[1:])
        s, e = words.start[a:b] - base, words.end[a:b] - base
        out[a:b] = mix((run[e] - run[s]) * down[s] + (e - s).astype(_U) * _U(0xA24BAED4963EE407))
        a = b
    return out


def ngram_hashes(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A mixed hash for every run of ``k`` consecutive word hashes (texts are not looked at)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    if k <= 8:
        total = np.zeros(n, _U)
        for j in range(k):
            total += hashes[j:j + n] * _U(pow(_WORD_STEP, j, 1 << 64))
    else:
        total = np.empty(n, _U)
        for a in range(0, n, _BLOCK):
            b = min(n, a + _BLOCK)
            up, down = _word_steps(b - a + k)
            run = np.zeros(b - a + k, _U)
            np.cumsum(hashes[a:b + k - 1] * up[:b - a + k - 1], out=run[1:])
            total[a:b] = (run[k:] - run[:b - a]) * down[:b - a]
    return mix(total + _U((k * 0x9FB21C651E98DF25 + salt * 0x632BE59BD9B4E019) & _MASK))


def inside(words: Words, k: int) -> np.ndarray:
    """Positions where ``k`` consecutive words lie in one text."""
    keep = np.zeros(max(0, len(words)), bool)
    for_each = words.counts - k + 1
    ok = np.flatnonzero(for_each > 0)
    if len(ok) == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, words.first[ok], 1)
    np.add.at(step, words.first[ok] + for_each[ok], -1)
    keep = np.cumsum(step[:-1]) > 0
    return np.flatnonzero(keep)


def pieces(at: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together, one text at least."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_batches(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) of pieces of a string column."""
    raw, at = utf8(column)
    for a, b in pieces(at, most):
        yield a, b, split_words(raw[at[a]:at[b]], at[a:b + 1] - at[a])


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at 16 MB and 10,000 rows where the session says nothing smaller."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(_bytes(spark.conf.get(key, "256m"))) > 16 << 20:
        spark.conf.set(key, str(16 << 20))


def _bytes(text: str) -> int:
    text = str(text).strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1:], 0)
    return int(float(text[:-1] if unit else text)) << unit


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




def add_columns(df: DataFrame, fields: list, build) -> DataFrame:
    """``df`` with the columns of ``fields`` (StructFields) that ``build(batch)``
    returns as Arrow arrays; an input column of the same name (in any case) is replaced."""
    from pyspark.sql import types as T

    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in keep]
    out_names = names + [f.name for f in fields]

    def run(batches):
        for batch in batches:
            made = build(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + made,
                                             names=out_names)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, T.StructType(keep + list(fields)))
