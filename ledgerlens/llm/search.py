"""Ranked lexical search: hybrid TAAT-DAAT over document shards.

Items (the queries) are taken in blocks of ``BLOCK_BYTES`` of text; a block's terms
and weights are what is broadcast. Documents stay where they are read, twice a block:

1. statistics: every task adds up, over all its documents, how many hold each of
   the block's terms, how many documents and how many terms there are;
2. search: every task takes its documents in pieces of about ``PIECE_BYTES`` and makes
   the postings of the block's terms in a piece. For every item that may still
   improve its ``k`` best (the sum of its lists' largest values is no less than its
   k-th best score so far), the **short lists** are added up term by term into
   accumulators, which from then on are one more iterator with a known bound (and
   their k-th largest value is one that the k best reach). Then
   **documents are taken in order**: lists are ranked by their bound, those whose
   bounds together stay below the k-th best score only serve to complete a
   document, and candidates come from the others. A candidate is completed list by
   list, by binary search in the long ones, as long as its bound allows; the k-th
   best score rises with every run of documents and carries over to the next piece.

A task sends the k best of each item. They are ranked within ``FAN`` neighbouring
tasks first and then as a whole, so no task gets more rows of an item than that.

Terms are runs of ASCII letters, digits and everything beyond ASCII; only A-Z are
lower-cased. They are equal by 64-bit hashes. Scores are integers; a term's weight
comes from the document frequency (``weight``), a document's factor from its length.

Rows: documents without doc_id take no part, also not in the statistics; null text
has no term; every row of a repeated doc_id is a document. Items without item_id
take no part; equal rows count once, rows of an item_id with other texts add their
terms. Equal scores are ranked by doc_id. Items and documents may have other
columns, which are not looked at. Without documents or terms there is no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .text import Words, bound_batches, byte_values, pieces, read_table, split_words, utf8, word_hashes

TOP = 10
BLOCK_BYTES = 4 << 20            # of items' texts that share the two scans
PIECE_BYTES = 4 << 20            # of documents whose postings a task holds
SHORT_SHARE = 16                 # a list is short if it holds at most one in so many of a piece's documents
FAN = 256                        # tasks whose results are ranked together first
FILTER_BITS = 20
LONGEST_RUN = 1024               # candidates completed together

# Fixed values of the score: length share in percent, and the factors of the saturation.
LENGTH_SHARE, UNIT, TF_STEP, LENGTH_STEP = 75, 1_000_000_000, 1000, 8

# Every byte that stands in no term becomes a blank.
_BYTES = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _BYTES[_a:_b + 1] = np.arange(_a, _b + 1)
_VALUES = byte_values(lower=True, seed=11)


def terms(raw: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    """The terms of texts, and their hashes."""
    words = split_words(_BYTES[raw], at)
    return words, word_hashes(words, _VALUES)


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n.astype(np.int64) * n_docs) // n_terms


@dataclass
class Items:
    """A block of items: its distinct term hashes in order, and each item's terms with their repeats."""
    ids: np.ndarray
    hashes: np.ndarray
    first: np.ndarray            # item i has entries first[i]:first[i + 1]
    term: np.ndarray             # index into hashes
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> "Items":
        raw, at = utf8(pa.array([t for _, t in rows], pa.large_string()))
        words, h = terms(raw, at)
        ids, item = np.unique(np.array([i for i, _ in rows], np.int64), return_inverse=True)
        hashes, term = np.unique(h, return_inverse=True)
        pair, times = np.unique(item[words.text] * max(1, len(hashes)) + term, return_counts=True)
        of = pair // max(1, len(hashes))
        return cls(ids, hashes, np.searchsorted(of, np.arange(len(ids) + 1)), pair % max(1, len(hashes)), times)

    def finder(self):
        """A function from hashes to (positions, term indices) of those that are terms of the block."""
        low = np.uint64((1 << FILTER_BITS) - 1)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[self.hashes & low] = True

        def find(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(seen[h & low])
            if len(at) == 0:
                return at, at
            index = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[index] == h[at]
            return at[hit], index[hit]
        return find


def _pieces(batches):
    """(doc_ids, term counts, document of each term, term hashes) of pieces of (doc_id, text) batches."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, at = utf8(batch.column(1))
        for a, b in pieces(at, PIECE_BYTES):
            words, h = terms(raw[at[a]:at[b]], at[a:b + 1] - at[a])
            yield ids[a:b], words.counts, words.text, h


def _postings(find, doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, tf) by term and document."""
    at, term = find(h)
    pair, tf = np.unique(term * n_docs + doc[at], return_counts=True)
    return pair // n_docs, pair % n_docs, tf


class Best:
    """The k best (score, doc_id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to matter: an equal score may have the smaller doc_id."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: (documents, summed values) of short lists."""
    docs = np.concatenate([d for d, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    start = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    return docs[start], np.add.reduceat(np.concatenate([v for _, v in lists])[order], start)


def _values_at(one: tuple[np.ndarray, np.ndarray], docs: np.ndarray) -> np.ndarray:
    """A list's values of ascending documents, 0 where it lacks one: a skip by binary search."""
    at = np.minimum(np.searchsorted(one[0], docs), len(one[0]) - 1)
    return np.where(one[0][at] == docs, one[1][at], 0)


def _candidates(lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return lists[0][0] if len(lists) == 1 else np.unique(np.concatenate([d for d, _ in lists]))


def search_lists(lists: list[tuple[np.ndarray, np.ndarray]], doc_ids: np.ndarray, best: Best, short: int) -> None:
    """Bring ``best`` up to date with the documents of an item's lists of (documents, values)."""
    few = [x for x in lists if len(x[0]) <= short]
    every = [x for x in lists if len(x[0]) > short]
    floor = 1                                                # k documents reach it
    if few:
        summed = accumulate(few)
        every.append(summed)
        known = np.concatenate([best.score, summed[1]])
        if len(known) >= best.k:
            floor = int(np.partition(known, len(known) - best.k)[len(known) - best.k])
    every.sort(key=lambda x: int(x[1].max()))
    bound = np.cumsum([int(x[1].max()) for x in every])
    least = max(floor, best.least)
    first = int(np.searchsorted(bound, least))               # lists before it only complete a document
    if first == len(every):
        return
    todo = _candidates(every[first:])
    at, run = 0, 16
    while at < len(todo):
        docs = todo[at:at + run]
        at, run = at + run, min(2 * run, LONGEST_RUN)
        score = np.zeros(len(docs), np.int64)
        for i in range(len(every) - 1, -1, -1):
            score += _values_at(every[i], docs)
            if i:
                may = score + bound[i - 1] >= least
                if not may.all():
                    docs, score = docs[may], score[may]
                if len(docs) == 0:
                    break
        keep = score >= least
        if keep.any():
            best.add(score[keep], doc_ids[docs[keep]])
            least = max(floor, best.least)
            now = int(np.searchsorted(bound, least))
            if now > first:                                  # fewer lists give candidates from here on
                first, done = now, todo[min(at, len(todo)) - 1]
                if first == len(every):
                    return
                todo = _candidates(every[first:])
                at, todo = 0, todo[todo > done]


def search_piece(items: Items, best: dict[int, Best], k: int, doc_ids: np.ndarray, term: np.ndarray, doc: np.ndarray,
                 value: np.ndarray, short: int) -> None:
    """All items over one piece's postings (by term and document)."""
    start = np.searchsorted(term, np.arange(len(items.hashes) + 1))
    most = np.zeros(len(items.hashes), np.int64)
    there = np.flatnonzero(start[1:] > start[:-1])
    if len(there) == 0:
        return
    most[there] = np.maximum.reduceat(value, start[there])
    bound = np.concatenate([[0], np.cumsum(most[items.term] * items.times)])
    bound = bound[items.first[1:]] - bound[items.first[:-1]]
    for i in np.flatnonzero(bound > 0):
        mine = best.get(i)
        if mine is None:
            mine = best[i] = Best(k)
        if bound[i] < mine.least:
            continue
        lists = []
        for e in range(items.first[i], items.first[i + 1]):
            a, b = start[items.term[e]], start[items.term[e] + 1]
            if b > a and most[items.term[e]]:
                lists.append((doc[a:b], value[a:b] * items.times[e]))
        search_lists(lists, doc_ids, mine, short)


def _statistics(docs: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms, document frequency of each term of the block); the block's terms are all that is collected."""
    def run(batches):
        items = block.value
        find, df, docs_seen, all_terms = items.finder(), np.zeros(len(items.hashes), np.int64), 0, 0
        for ids, n, doc, h in _pieces(batches):
            docs_seen += int((n > 0).sum())
            all_terms += int(n.sum())
            term, _, _ = _postings(find, doc, h, len(ids))
            df += np.bincount(term, minlength=len(df))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, there], pa.int64()),
                                          pa.array(np.r_[docs_seen, all_terms, df[there]], pa.int64())], names=["term", "n"])

    found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(block.value.hashes), np.int64)
    totals = {-2: 0, -1: 0}
    for r in found.collect():
        if r["term"] < 0:
            totals[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return totals[-2], totals[-1], df


def _search_block(docs: DataFrame, rows: list[tuple[int, str]], k: int) -> DataFrame | None:
    sc = docs.sparkSession.sparkContext
    items = Items.of(rows)
    if len(items.hashes) == 0:
        return None
    block = sc.broadcast(items)
    n_docs, n_terms, df = _statistics(docs, block)
    if n_terms == 0:
        return None
    weights = sc.broadcast(weight(n_docs, df))

    def run(batches):
        items, w = block.value, weights.value
        find, best = items.finder(), {}
        for ids, n, doc, h in _pieces(batches):
            term, doc, tf = _postings(find, doc, h, len(ids))
            value = w[term] * ((UNIT * tf) // (TF_STEP * tf + LENGTH_STEP * length_factor(n, n_docs, n_terms)[doc]))
            search_piece(items, best, k, ids, term, doc, value, max(4, len(ids) // SHORT_SHARE))
        for i, mine in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(mine.doc), items.ids[i])), pa.array(mine.doc), pa.array(mine.score),
                 pa.array(np.full(len(mine.doc), TaskContext.get().partitionId() // FAN))],
                names=["item_id", "doc_id", "score", "tasks"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long, tasks long")


def _blocks(items: DataFrame):
    """Lists of (item_id, text) of about ``BLOCK_BYTES``, one after the other."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"]) + 64
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents (doc_id, text) that score highest for each item (item_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    found = None
    for rows in _blocks(asked):
        one = _search_block(docs, rows, k)
        if one is not None:
            found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = [F.desc("score"), "doc_id"]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    found = found.withColumn("rank", place("item_id", "tasks")).where(F.col("rank") <= k)
    return found.withColumn("rank", place("item_id")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL
),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS nd, CAST(sum(len(terms)) AS BIGINT) AS nt FROM d),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL
),
postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, nd
),
scored AS (
  SELECT item_id, r, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
