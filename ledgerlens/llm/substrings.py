"""Substring dedup with prefix-partitioned, anchored suffix trees over words.

A *window* is ``width`` consecutive words of one document. Every window is
reached from its anchor, the suffix that starts at the window's least gram of
``GRAM`` words (least by hash, so equal windows have equal anchors). The
anchor's prefix decides which group a window goes to: neighbouring windows
share an anchor, so a run of them travels as one entry (document, first word,
labels) and no text is shuffled. A first scan counts the windows by slots of the
prefix' hash; groups are dealt over as many bins as keep a bin at ``BIN_WINDOWS``
windows, and the prefixes of a slot with more than half a bin are extended by part
of the label, so that its windows go to several bins (equal windows agree in both).
Within a bin the windows of each prefix are sorted by label (the
64-bit fingerprint of the path of ``width`` words, read together with the
64-bit prefix): equal neighbours are the leaves under one internal node of
depth ``width`` or more. A node with leaves in two documents is a repeat; the
smallest document keeps it, and in all others the window is covered.
Consecutive covered windows join to the maximal repeats.

Hot passages: each task first compares the windows of its own batch, marks
those that start in a smaller document of the batch, and ships only the rest,
so a passage that a third of all documents share costs one entry a batch.

Rows: null text has no words; a row without doc_id takes no part and is not
returned. Rows that repeat a doc_id are told apart by their text: equal texts
get equal results, other texts are judged each for itself, and no row counts as
a smaller document for another row of its own doc_id. Other columns of the
input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_package
from .text import (add_columns, bound_batches, byte_values, inside, mix, ngram_hashes, partitions, read_table,
                   split_words, utf8, pieces, word_hashes)

WIDTH = 50
GRAM = 10
BINS_A_PARTITION = 4
BIN_WINDOWS = 2_000_000         # about 200 MB while a bin is compared
SLOTS_A_BIN = 64


def least_grams(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For every run of ``width`` words, the least hash among its grams."""
    least = ngram_hashes(hashes, gram)
    left = width - gram + 1
    span = 1
    while 2 * span <= left:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < left:
        least = np.minimum(least[:span - left], least[left - span:])
    return least


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows that agree in all columns."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def later_windows(prefix: np.ndarray, label: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows have their word sequence in a smaller document, among those given."""
    order = np.argsort(label, kind="stable")
    l, p, d = label[order], prefix[order], doc[order]
    if np.any((l[1:] == l[:-1]) & (p[1:] != p[:-1])):     # equal labels under different prefixes
        order = np.lexsort((prefix, label))
        l, p, d = label[order], prefix[order], doc[order]
    start = runs_of(l, p)
    first = np.minimum.reduceat(d, start) if len(start) else d
    out = np.zeros(len(label), bool)
    out[order] = d > np.repeat(first, np.diff(np.r_[start, len(l)]))
    return out


def _spans(at: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered windows (sorted by row and start) as (row, from word, to word) of their maximal runs."""
    if len(at) == 0:
        return row, at, at
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[new[1:], len(at)] - 1
    return row[new], at[new], at[last] + width


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _covered(doc, text, lo, hi) -> bytes:
    """A message of covered spans (a negative count tells it from window entries)."""
    return _pack(np.array([-len(doc)], np.int64), doc, text, lo.astype(np.int64), hi.astype(np.int64))


class Dealing:
    """Which bin a window goes to: by its prefix, and in heavy slots of the prefix' hash also by its label."""

    def __init__(self, bins: int, slots: int, heavy: dict[int, int] | None = None):
        """``heavy``: for slots that have to be split, into how many."""
        self.bins, self.slots = bins, slots
        self.slot = np.array(sorted(heavy or {}), np.int64)
        self.ways = np.array([heavy[i] for i in self.slot.tolist()] if heavy else [], np.uint64)

    def slot_of(self, prefix: np.ndarray) -> np.ndarray:
        return (mix(prefix) % np.uint64(self.slots)).astype(np.int64)

    def bin_of(self, prefix: np.ndarray, label: np.ndarray) -> np.ndarray:
        key = mix(prefix)
        if len(self.slot):
            slot = self.slot_of(prefix)
            place = np.minimum(np.searchsorted(self.slot, slot), len(self.slot) - 1)
            split = np.flatnonzero(self.slot[place] == slot)
            key[split] = mix(key[split] + mix(label[split]) % self.ways[place[split]])
        return (mix(key) % np.uint64(self.bins)).astype(np.int64)


def _windows(column, doc_ids, text_hashes, width: int) -> Iterator[tuple]:
    """For the pieces of one Arrow batch: the covered spans within the piece, if
    any, as a message, and (prefix, label, doc, text, start, row) of the other windows."""
    values = byte_values(lower=False, seed=6)
    raw, at = utf8(column)
    for a, b in pieces(at, 1 << 23):
        words = split_words(raw[at[a]:at[b]], at[a:b + 1] - at[a])
        spot = inside(words, width)
        if len(spot) == 0:
            continue
        hashes = word_hashes(words, values)
        prefix, label = least_grams(hashes, width, GRAM)[spot], ngram_hashes(hashes, width, salt=1)[spot]
        row = words.text[spot]
        doc, text, start = doc_ids[a:b][row], text_hashes[a:b][row], spot - words.first[row]
        later = later_windows(prefix, label, doc)
        covered = None
        if later.any():
            r, lo, hi = _spans(start[later], row[later], width)
            covered = _covered(doc_ids[a:b][r], text_hashes[a:b][r], lo, hi)
        ship = np.flatnonzero(~later)
        yield covered, [x[ship] for x in (prefix, label, doc, text, start, row)]


def _window_entries(column, doc_ids, text_hashes, width: int, dealing: Dealing) -> Iterator[tuple[int, bytes]]:
    """(bin, message) for the windows of one Arrow batch."""
    for covered, (prefix, label, doc, text, start, row) in _windows(column, doc_ids, text_hashes, width):
        if covered is not None:
            yield int(mix(np.array([doc[0]], np.int64).view(np.uint64))[0] % np.uint64(dealing.bins)), covered
        at = dealing.bin_of(prefix, label)
        first = runs_of(prefix, row, start - np.arange(len(start)), at)
        count = np.diff(np.r_[first, len(start)])
        to = at[first]
        order = np.argsort(to, kind="stable")
        cut = runs_of(to[order])
        for x, y in zip(cut, np.r_[cut[1:], len(order)]):
            part = order[x:y]
            f, c = first[part], count[part]
            window = np.repeat(f - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
            yield int(to[part[0]]), _pack(np.array([len(part)], np.int64), prefix[f], doc[f], text[f],
                                          start[f].astype(np.uint32), c.astype(np.uint32), label[window])


def deal(rows: DataFrame, width: int, parts: int, bin_windows: int = BIN_WINDOWS) -> Dealing:
    """Count the windows of ``rows`` (doc_id, text_hash, text) by slot, and size the bins."""
    slots = parts * BINS_A_PARTITION * SLOTS_A_BIN
    by = Dealing(1, slots)

    def count(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for _, (prefix, *_rest) in _windows(batch.column(2), *ids, width):
                np.add.at(total, by.slot_of(prefix), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())],
                                         names=["slot", "n"])

    found = rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = materialize(found, as_table=True)
    windows = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    bins = max(parts * BINS_A_PARTITION, -(-2 * windows // bin_windows))
    most = max(1, windows // (2 * bins))                # half a bin; so at most 2 * bins slots are heavier
    heavy = {r["slot"]: -(-r["n"] // most) for r in found.where(F.col("n") > most).collect()}
    return Dealing(bins, slots, heavy)


def _read(message: bytes, kinds) -> list:
    n = abs(int(np.frombuffer(message, np.int64, 1)[0]))
    at, out = 8, []
    for kind in kinds:
        out.append(np.frombuffer(message, kind, n, at))
        at += out[-1].nbytes
    return [*out, message[at:]]


def _bin_repeats(messages: list[bytes], width: int) -> list[np.ndarray]:
    """(doc_id, text_hash, from, to) of the covered spans that one bin's subtrees show."""
    read = [_read(m, (np.uint64, np.int64, np.int64, np.uint32, np.uint32)) for m in messages]
    prefix, doc, text, start, count = (np.concatenate(x) for x in list(zip(*read))[:5])
    label = np.concatenate([np.frombuffer(r[5], np.uint64) for r in read])
    count = count.astype(np.int64)
    entry = np.repeat(np.arange(len(count)), count)
    later = np.flatnonzero(later_windows(prefix[entry], label, doc[entry]))
    offset = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    e = entry[later]
    e, lo, hi = _spans(start[e].astype(np.int64) + offset[later], e, width)
    return [doc[e], text[e], lo, hi]


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, from_word, to_word): word ranges, from 0, ``to_word``
    not included, whose windows also start in a smaller document. Ranges of one
    text may touch or overlap; together they are the covered words."""
    if width < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    parts = partitions(df)
    rows = _numbered(df, doc_id, text)
    dealing = deal(rows, width, parts)

    def cut(batches):
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            found = [*_window_entries(batch.column(2), *ids, width, dealing)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()),
                                              pa.array([m for _, m in found], pa.binary())], names=["bin", "message"])

    def out(columns):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k) for c, k in zip(columns, kinds)],
                                          names=["doc_id", "text_hash", "from_word", "to_word"])

    def grow(batches):
        now, held = None, []
        for batch in batches:
            for key, message in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if np.frombuffer(message, np.int64, 1)[0] < 0:
                    yield out(_read(message, (np.int64,) * 4)[:4])
                    continue
                if key != now and held:
                    yield out(_bin_repeats(held, width))
                    held = []
                now = key
                held.append(message)
        if held:
            yield out(_bin_repeats(held, width))

    dealt = rows.mapInArrow(cut, "bin int, message binary").repartition(parts, "bin")
    return dealt.sortWithinPartitions("bin").mapInArrow(
        grow, "doc_id long, text_hash long, from_word int, to_word int")


def _numbered(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every row of ``df`` that has a
    doc_id, without the covered words; kept words are joined by one space."""
    spans = repeats(df, doc_id, text, width).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("from_word", "to_word")).alias("spans"))
    rows = _numbered(df, doc_id, text).join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")

    def build(batch):
        total, gone, kept = [], [], []
        for whole, found in zip(batch.column(1), batch.column(2)):
            words = whole.as_py().encode("utf-8", "replace").split()
            total.append(len(words))
            if found.is_valid:
                step = np.zeros(len(words) + 1, np.int64)
                flat = found.values
                np.add.at(step, flat.field(0).to_numpy(), 1)
                np.add.at(step, flat.field(1).to_numpy(), -1)
                keep = np.cumsum(step[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist()) if k]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        return [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_text", T.StringType())]
    return add_columns(rows, fields, build).drop("text", "spans")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word passages that start in a smaller document."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
