"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

A document is held against benchmark items through its *item-sized windows*:
runs of as many words as an item has (the whole document where it is shorter).
Windows and items have 128-bit SimHash fingerprints over their words. The
fingerprint is cut into ``BLOCKS`` blocks; if two fingerprints differ in at most
``RADIUS`` bits, some block differs in at most ``RADIUS // BLOCKS``. For every
item length and block there is a bitmap of all block values so near to an
item's, so one look per block finds every fingerprint within the radius. The
candidates are verified exactly: the weighted Jaccard similarity of their
five-word shingles (weights are multiplicities) must be ``SIMILARITY`` or more.
A window that shares no shingle with an item of its length has similarity 0 and
is not fingerprinted.

The documents are scanned once and never shuffled. The items go to the tasks in
chunks of about ``CHUNK_BYTES`` of text, one scan a chunk, so a broadcast is
bounded whatever the size of the benchmark; of several chunks each one's result is
written before the next one is sent. Bit sums of a text are held for at most
``RUN_WORDS`` words and a window at a time, however long the text is.

Rows: A-Z count as a-z; null and empty texts match nothing. An item with fewer
than five words is one shingle of all its words, so it is found where these stand
in a row (and a very common one marks many documents); items without words or
text take no part. Repeated items count once, documents that repeat are each
judged; of equally similar windows the first is told. All columns of the input
stay as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_package
from .text import (add_columns, bound_batches, byte_values, inside, mix, ngram_hashes, pieces, read_table, split_words,
                   utf8, word_hashes)

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 31
BLOCKS = 8
BLOCK_BITS = 16
CHUNK_BYTES = 8 << 20
FILTER_BITS = 22
RUN_WORDS = 1 << 15
_VALUES = byte_values(lower=True, seed=3)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of each word."""
    both = np.stack([hashes, mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """The blocks of the fingerprints with these bit sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1)


def near_masks(bits: int, width: int = BLOCK_BITS) -> np.ndarray:
    """All block values with at most ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(width), k)], np.uint16)


def weighted_jaccard(a: np.ndarray, b: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity of the multiset of hashes ``a`` with the (distinct, counts) of another."""
    values, counts = np.unique(a, return_counts=True)
    place = np.minimum(np.searchsorted(b[0], values), len(b[0]) - 1)
    common = np.minimum(counts, b[1][place])[b[0][place] == values].sum()
    return float(common / (counts.sum() + b[1].sum() - common))


def _running(hashes: np.ndarray) -> np.ndarray:
    return np.vstack([np.zeros((1, 128), np.int32), np.cumsum(signs(hashes), axis=0)])


def window_codes(hashes: np.ndarray, start: np.ndarray, span: int) -> np.ndarray:
    """The SimHashes of windows of ``span`` words at ascending starts, for a stretch of ``RUN_WORDS`` words at a time."""
    out, a = [], 0
    while a < len(start):
        b = int(np.searchsorted(start, start[a] + RUN_WORDS, "left"))
        lo = start[a]
        run = _running(hashes[lo:start[b - 1] + span])
        out.append(packed(run[start[a:b] + span - lo] - run[start[a:b] - lo]))
        a = b
    return np.concatenate(out)


class Items:
    """The index over one chunk of items. Items of fewer words than a shingle are one shingle of all their words."""

    def __init__(self, ids: list, texts: list[str], radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        words = split_words(*utf8(pa.array(texts, pa.string())))
        hashes = word_hashes(words, _VALUES)
        self.ids, self.length, self.code, self.grams = [], [], [], []
        short: dict[int, list[tuple]] = {}
        for i in range(len(texts)):
            h = hashes[words.first[i]:words.first[i + 1]]
            if 0 < len(h) < SHINGLE:
                short.setdefault(len(h), []).append((int(ngram_hashes(h, len(h))[0]), i))
            elif len(h) >= SHINGLE:
                self.ids.append(ids[i])
                self.length.append(len(h))
                self.code.append(packed(signs(h).sum(axis=0, keepdims=True))[0])
                self.grams.append(np.unique(ngram_hashes(h, SHINGLE), return_counts=True))
        # For each length below a shingle's: the hashes in order, and their items.
        self.short = {n: (np.array([h for h, _ in sorted(found)], np.uint64), [ids[i] for _, i in sorted(found)])
                      for n, found in short.items()}
        owner = np.repeat(np.arange(len(self.ids)), [len(g[0]) for g in self.grams])
        every = np.concatenate([g[0] for g in self.grams] or [np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.gram, self.owner = every[order], owner[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(every >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.by_length: dict[int, np.ndarray] = {}
        for i, n in enumerate(self.length):
            self.by_length.setdefault(n, []).append(i)
        self.masks = near_masks(radius // BLOCKS)
        self.near: dict[int, np.ndarray] = {}

    def _near(self, length: int) -> np.ndarray:
        """Per block a bitmap of the values that are near to an item of this length."""
        if length not in self.near:
            table = np.zeros((BLOCKS, 1 << BLOCK_BITS), bool)
            for i in self.by_length[length]:
                for b in range(BLOCKS):
                    table[b, self.code[i][b] ^ self.masks] = True
            if len(self.near) >= 64:
                self.near.clear()
            self.near[length] = np.packbits(table, axis=1)
        return self.near[length]

    def _windows(self, length: int, hits: np.ndarray, n: int) -> np.ndarray:
        """Starts of the windows of ``length`` words that hold one of the shingles at ``hits``."""
        if n <= length:
            return np.zeros(1, np.int64)
        step = np.zeros(n - length + 2, np.int32)
        np.add.at(step, np.maximum(hits - (length - SHINGLE), 0), 1)
        np.add.at(step, np.minimum(hits, n - length) + 1, -1)
        return np.flatnonzero(np.cumsum(step[:-1]) > 0)

    def matches(self, hashes: np.ndarray, grams: np.ndarray, hits: np.ndarray) -> list[tuple]:
        """(item, first word, words, similarity, distance) of the best window for each item that this text contains."""
        left, right = (np.searchsorted(self.gram, grams[hits], side) for side in ("left", "right"))
        size = right - left
        if not size.any():
            return []
        which = np.repeat(hits, size)
        owner = self.owner[np.repeat(left - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        lengths = np.array(self.length)[owner]
        out, run, n = [], None, len(hashes)
        for length in np.unique(lengths):
            at = np.unique(which[lengths == length])
            start = self._windows(int(length), at, n)
            if run is None:
                lo = 0 if n <= lengths.max() else max(0, int(hits.min()) - int(lengths.max()))
                hi = min(n, int(hits.max()) + int(lengths.max()) + SHINGLE)
                # Sums for all words from the first hit to the last one serve every length, if they are few.
                run = _running(hashes[lo:hi]) if hi - lo <= RUN_WORDS else False
            span = min(int(length), n)
            if run is False:
                codes = window_codes(hashes, start, span)
            else:
                codes = packed(run[start + span - lo] - run[start - lo])
            near = self._near(int(length))
            found = np.zeros(len(codes), bool)
            for b in range(BLOCKS):
                found |= (near[b, codes[:, b] >> 3] >> (7 - (codes[:, b] & 7))) & 1 == 1
            start, codes = start[found], codes[found]
            for i in set(owner[lengths == length].tolist()):
                far = distance(codes, self.code[i])
                best = None
                for j in np.flatnonzero(far <= self.radius):
                    s = int(start[j])
                    value = weighted_jaccard(grams[s:s + span - SHINGLE + 1], self.grams[i])
                    if value >= self.similarity and (best is None or value > best[3]):
                        best = (self.ids[i], s, span, value, int(far[j]))
                if best:
                    out.append(best)
        return sorted(out, key=lambda m: (m[0] is None, m[0]))

    def _short_matches(self, words, hashes: np.ndarray) -> list[tuple[int, tuple]]:
        """(text, match) of the first place of every short item in each text; equal words have SimHash distance 0."""
        out = []
        for n, (known, ids) in self.short.items():
            spot = inside(words, n)
            if len(spot) == 0:
                continue
            h = ngram_hashes(hashes, n)[spot]
            spot = spot[np.isin(h, known)]
            text = np.searchsorted(words.first, spot, "right") - 1
            seen = set()
            for t, s in zip(text.tolist(), spot.tolist()):
                g = ngram_hashes(hashes[s:s + n], n)[0]
                if (t, int(g)) not in seen:
                    seen.add((t, int(g)))
                    lo, hi = np.searchsorted(known, g, "left"), np.searchsorted(known, g, "right")
                    out += [(t, (ids[i], s - int(words.first[t]), n, 1.0, 0)) for i in range(lo, hi)]
        return out

    def search(self, column) -> list[list[tuple]]:
        """For each text of a batch its matches."""
        raw, at = utf8(column)
        out: list[list[tuple]] = []
        for a, b in pieces(at):
            words = split_words(raw[at[a]:at[b]], at[a:b + 1] - at[a])
            hashes = word_hashes(words, _VALUES)
            grams = ngram_hashes(hashes, SHINGLE)
            spot = inside(words, SHINGLE)
            spot = spot[self.filter[(grams[spot] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
            found: list[list[tuple]] = [[] for _ in range(b - a)]
            text = np.searchsorted(words.first, spot, "right") - 1
            for i in np.unique(text):
                lo, hi = words.first[i], words.first[i + 1]
                found[i] = self.matches(hashes[lo:hi], grams[lo:max(lo, hi - SHINGLE + 1)], spot[text == i] - lo)
            for i, match in self._short_matches(words, hashes) if self.short else ():
                found[i] = sorted(found[i] + [match], key=lambda m: (m[0] is None, m[0]))
            out += found
        return out


_INDEX: list[tuple] = []


def _index(rows, radius: int, similarity: float) -> Items:
    """The worker's index over a broadcast chunk. The entry holds the chunk, so no other can be taken for it."""
    value = rows.value
    if not _INDEX or _INDEX[0][0] is not value or _INDEX[0][1:3] != (radius, similarity):
        _INDEX[:] = [(value, radius, similarity, Items(*value, radius, similarity))]
    return _INDEX[0][3]


def item_chunks(items: DataFrame, item_id: str, text: str):
    """(broadcast of (ids, texts), whether there are more), each of about ``CHUNK_BYTES``; every item is in one of them."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    count = max(1, -(-size // CHUNK_BYTES))
    for c in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == c).orderBy("item_id", "text").collect()
        yield items.sparkSession.sparkContext.broadcast(([r.item_id for r in part], [r.text for r in part])), count > 1


MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("from_word", T.IntegerType()),
                                  T.StructField("n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
                                  T.StructField("distance", T.IntegerType())]))


def find(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(columns of ``df`` without the text, and item_id, from_word, n_words,
    similarity, distance): a row for each document and item that it contains,
    with the most similar window (the first of equals)."""
    ship_package(df.sparkSession)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("from_word", pa.int32()), ("n_words", pa.int32()),
                               ("similarity", pa.float64()), ("distance", pa.int32())]))
    names = [f.name for f in kind.value_type]
    parts = []
    for rows, several in item_chunks(items, item_id, item_text):
        def build(batch, rows=rows):
            found = _index(rows, radius, similarity).search(batch.column(batch.schema.get_field_index(text)))
            return [pa.array([[dict(zip(names, m)) for m in ms] for ms in found], kind)]

        matched = add_columns(df, [T.StructField("matches", MATCH)], build)
        keep = [c for c in df.columns if c.lower() not in {text.lower(), "matches", *names}]
        part = matched.where(F.size("matches") > 0).select(*keep, F.inline("matches"))
        if several:                                      # written, so that one chunk at a time is held
            part = materialize(part, as_table=True)
            rows.unpersist()
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def without_contaminated(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                         item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, unchanged, that contain no item."""
    ship_package(df.sparkSession)
    out, columns = df, df.columns
    for rows, several in item_chunks(items, item_id, item_text):
        def build(batch, rows=rows):
            found = _index(rows, radius, similarity).search(batch.column(batch.schema.get_field_index(text)))
            return [pa.array([bool(ms) for ms in found], pa.bool_())]

        flag = "contaminated_"
        while flag in {c.lower() for c in columns}:
            flag += "_"
        out = add_columns(out, [T.StructField(flag, T.BooleanType())], build).where(~F.col(flag)).select(*columns)
        if several:
            out = materialize(out, as_table=True)
            rows.unpersist()
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with its best window."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, read_table(spark, sf_dir, "benchmark"))
