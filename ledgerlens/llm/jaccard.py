"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row a document and a column a shingle (64-bit hash of
``words`` consecutive words). Two documents with shingle sets x and y link when
``100 |x & y| >= percent |x | y|``. Their overlap is an entry of the product of
the matrix with its transpose, of which only what a link may need is made:

1. Column sums over the whole corpus (asked and answered by hash bins, see
   ``exchange``). A linked document shares ``percent`` of its shingles or more,
   so a row with too few columns of sum 2 or more has no link and leaves the
   product; so do columns of sum 1. Equal sets collapse to one row.
2. The same again over the rows left, now with the exact sums, by which each
   row orders its columns, rarest first.
3. Rows that agree in the least of their hashes (several hash orders), and then
   rows that share a column of their prefix (the first ``n - need + 1``
   columns; two linked rows always share one), are compared with the most
   shared-in row there: a group costs one comparison a row, not one a pair.
4. What such comparisons left in different components is multiplied out: the
   prefix columns are dealt to bins, long ones as blocks of rows times blocks of
   rows. A bin first leaves out the rows that by their sizes and their numbers of
   columns can link with no row of the column, and makes the products of the others
   over different components, again only where sizes and columns allow a link.
   The partial overlaps are added up by pair, and pairs that cannot reach the
   size-derived bound ``percent (|x| + |y|) / (100 + percent)`` even if all columns
   beyond the prefix agree are dropped. The rest is compared in full.

So all links between different components are tested, none is lost, and
members of one group need not be expanded into all pairs.

Rows: A-Z count as a-z; a text of fewer words than a shingle has its whole
sequence as one shingle; null and empty texts have none and link with nothing.
Rows without doc_id take no part and are not returned. Rows that repeat a
doc_id are one document of several texts: each is returned with its own
``n_shingles``, and they share a component if one of them links. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .exchange import MESSAGE, answers, messages, number_of_batches, totals
from .graph import components
from .text import (bound_batches, byte_values, inside, mix, ngram_hashes, partitions, read_table, split_words, utf8,
                   word_hashes)

WORDS = 5
PERCENT = 75
HASH_ORDERS = 4
BATCH_ENTRIES = 2_000_000       # matrix entries in one batch of sets
BROADCAST_PAIRS = 200_000
COLUMN_ROWS = 1024              # rows of a column that one cell multiplies
_VALUES = byte_values(lower=True, seed=4)


def shingles(column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted distinct shingle hashes of a batch of texts, and the distinct
    entries (text, place in the list) by text and hash; number of texts."""
    w = split_words(*utf8(column))
    n = len(w.first) - 1
    h = word_hashes(w, _VALUES)
    spot = inside(w, words)
    rows, grams = [w.text[spot]], [ngram_hashes(h, words)[spot]]
    for k in range(1, words):
        short = np.flatnonzero(w.counts == k)
        if len(short):
            rows.append(short)
            grams.append(ngram_hashes(h, k)[w.first[short]])
    rows, grams = np.concatenate(rows), np.concatenate(grams)
    listed, place = np.unique(grams, return_inverse=True)
    key = np.unique(rows * max(1, len(listed)) + place)
    return listed, key // max(1, len(listed)), key % max(1, len(listed)), n


def fingerprints(listed, row, place, n) -> tuple[np.ndarray, list]:
    """Set sizes, and a 128-bit fingerprint of each set (None: no shingle)."""
    size = np.bincount(row, minlength=n)
    has = np.flatnonzero(size)
    start = (np.cumsum(size) - size)[has]
    out: list = [None] * n
    if len(has):
        parts = [np.add.reduceat(mix(listed ^ np.uint64(c))[place], start) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        both = np.stack([mix(parts[0] + size[has].astype(np.uint64)), parts[1]], axis=1)
        for i, f in zip(has, both):
            out[i] = f.tobytes()
    return size, out


def _lists(values: np.ndarray, size: np.ndarray, present: np.ndarray) -> pa.Array:
    """An Arrow list column: ``size`` values for each present row, null for the others."""
    lengths = np.where(present, size, 0)
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    valid = pa.array(~present)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()), mask=valid)


def _need(n, percent: int):
    return -(-percent * n // 100)


TEXT = "h1 long, h2 long, text string"
ROW = "h1 long, h2 long, n_shingles long, fingerprint binary, node long, hashes array<long>"


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The texts of each Arrow batch, equal ones once: a text that many rows share is shuffled once a batch."""

    def once(batches):
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            _, first = np.unique(keys, axis=0, return_index=True)
            yield batch.take(pa.array(np.sort(first))) if len(first) < len(keys) else batch

    return docs.select("h1", "h2", "text").mapInArrow(once, TEXT)


def incidence(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Step 1: every distinct text with its set size and fingerprint; its shared shingle hashes only if it may have a link."""
    parts = partitions(docs)
    batches = number_of_batches(docs, "text", parts)
    dealt = distinct_texts(docs).withColumn("batch", F.pmod("h1", F.lit(batches))).repartition(parts, "batch")

    def own(table):
        """The rows of a batch, equal texts once."""
        keys = np.stack([np.asarray(table["h1"]), np.asarray(table["h2"])], axis=1)
        _, first = np.unique(keys, axis=0, return_index=True)
        return table.take(pa.array(first))          # by key, so the same rows in the same order each time

    def ask(key, table):
        listed, _, place, _ = shingles(own(table)["text"], words)
        return messages(key[0].as_py(), listed, np.bincount(place, minlength=len(listed)), batches)

    def keep(key, table, answered):
        table = own(table)
        listed, row, place, n = shingles(table["text"], words)
        size, prints = fingerprints(listed, row, place, n)
        shared = totals(answered)[place] >= 2
        count = np.bincount(row[shared], minlength=n)
        carries = (size > 0) & (count >= _need(size, percent))
        return pa.table({"h1": table["h1"], "h2": table["h2"], "n_shingles": pa.array(size, pa.int64()),
                         "fingerprint": pa.array(prints, pa.binary()),
                         "node": pa.array([p and int.from_bytes(p[:8], "little", signed=True) for p in prints], pa.int64()),
                         "hashes": _lists(listed[place[shared & carries[row]]], count, carries)})

    asked = dealt.groupBy("batch").applyInArrow(ask, MESSAGE)
    return dealt.groupBy("batch").cogroup(answers(asked, parts).groupBy("batch")).applyInArrow(keep, ROW)


SET = "node long, n long, hashes array<long>, prefix int, keys array<long>, share double"


def ordered_sets(rows: DataFrame, percent: int) -> DataFrame:
    """Step 2: the distinct sets that still may have a link, by node (the first half
    of the fingerprint), columns rarest first, and their least hashes under several hash orders."""
    parts = partitions(rows)
    some = rows.where("hashes is not null").select("node", F.col("n_shingles").alias("n"), "hashes")
    size = rows.where("hashes is not null").agg(F.sum("n_shingles").alias("b")).first()["b"] or 0
    batches = max(parts, -(-size // BATCH_ENTRIES))
    dealt = some.withColumn("batch", F.pmod("node", F.lit(batches))).repartition(parts, "batch")

    def own(table):
        """The distinct sets of a batch: equal ones are in one batch."""
        nodes, first = np.unique(np.asarray(table["node"]), return_index=True)
        return nodes, table.take(pa.array(first))

    def entries(table):
        lists = table["hashes"].combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        count = np.asarray(lists.value_lengths())
        listed, place = np.unique(values, return_inverse=True)
        return listed, np.repeat(np.arange(len(count)), count), place

    def ask(key, table):
        listed, _, place = entries(own(table)[1])
        return messages(key[0].as_py(), listed, np.bincount(place, minlength=len(listed)), batches)

    def order(key, table, answered):
        nodes, table = own(table)
        listed, row, place = entries(table)
        n = np.asarray(table["n"])
        total = totals(answered)[place]
        use = total >= 2
        row, place, total = row[use], place[use], total[use]
        count = np.bincount(row, minlength=len(n))
        stays = np.flatnonzero(count >= _need(n, percent))
        use = np.isin(row, stays)
        row, place, total = row[use], place[use], total[use]
        by = np.lexsort((listed[place], total, row))
        row, hashes = row[by], listed[place[by]]
        count, size = count[stays], n[stays]
        start = np.cumsum(count) - count
        least = [np.minimum.reduceat(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))), start)
                 if len(stays) else np.zeros(0, np.uint64) for j in range(HASH_ORDERS)]
        keys = np.stack(least, axis=1).reshape(-1) if len(stays) else np.zeros(0, np.uint64)
        yes = np.ones(len(stays), bool)
        return pa.table({"node": pa.array(nodes[stays], pa.int64()), "n": pa.array(size, pa.int64()),
                         "hashes": _lists(hashes, count, yes),
                         "prefix": pa.array(np.maximum(1, count - _need(size, percent) + 1), pa.int32()),
                         "keys": _lists(keys, np.full(len(stays), HASH_ORDERS), yes),
                         "share": pa.array(count / size, pa.float64())})

    asked = dealt.groupBy("batch").applyInArrow(ask, MESSAGE)
    return dealt.groupBy("batch").cogroup(answers(asked, parts).groupBy("batch")).applyInArrow(order, SET)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, compared in full. Few pairs are
    broadcast, so that only the sets they name are shuffled."""
    pairs = materialize(pairs, as_table=True)
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda x: x)
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("set_b"))
    b = b.join(few(pairs.select("b").distinct()), "b", "left_semi")
    both = a.join(few(pairs), "a").join(b, "b").where(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    both = both.withColumn("overlap", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(f"100 * overlap >= {percent} * (n_a + n_b - overlap)").select("a", "b")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    known = found.select("node", F.col("component").alias("known"))
    return rows.join(known, "node", "left").withColumn("component", F.coalesce("known", "node")).drop("known")


def _to_centres(keyed: DataFrame, key: list[str], any_row: bool = False) -> DataFrame:
    """Pairs (a, b) of each row and one row of its key's group, in other components
    only: the row that shares most, or (``any_row``) another one for each key."""
    first = F.xxhash64("node", *key) if any_row else -F.col("share")
    centre = keyed.groupBy(*key).agg(
        F.min(F.struct(first.alias("first"), "node", "component")).alias("c"),
        F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(
        *key, F.col("c.node").alias("b"), F.col("c.component").alias("of_b"))
    return keyed.join(centre, key).where("component <> of_b").select(F.col("node").alias("a"), "b").distinct()


def may_link(n: np.ndarray, columns: np.ndarray, percent: int) -> np.ndarray:
    """For every two kinds of rows, of ``n`` shingles and ``columns`` of them in the
    product, whether such rows can link: by size, and as all their common columns are in the product."""
    low, high = np.minimum.outer(n, n), np.maximum.outer(n, n)
    return (100 * low >= percent * high) & (
        (100 + percent) * np.minimum.outer(columns, columns) >= percent * np.add.outer(n, n))


def column_pairs(node: np.ndarray, comp: np.ndarray, block: np.ndarray, n: np.ndarray, columns: np.ndarray,
                 percent: int, apart: bool) -> np.ndarray:
    """The pairs (places) of one column's rows that lie in different components and may
    link; ``apart``: rows of different blocks only. Rows that can link with none of
    the column leave it before any pair is made."""
    kinds, kind = np.unique(np.stack([n, columns], axis=1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    able = may_link(kinds[:, 0], kinds[:, 1], percent)
    live = np.flatnonzero(able.any(axis=1)[kind])
    live = live[np.argsort(comp[live], kind="stable")]
    end = np.searchsorted(comp[live], comp[live], "right")
    made = []
    for i in range(len(live)):
        others = live[end[i]:]
        ok = able[kind[live[i]], kind[others]]
        if apart:
            ok &= block[others] != block[live[i]]
        others = others[ok]
        if len(others):
            made.append(np.stack([np.full(len(others), live[i]), others], axis=1))
    return np.concatenate(made) if made else np.zeros((0, 2), np.int64)


def products(prefixes: DataFrame, parts: int, percent: int) -> DataFrame:
    """(a, b): rows of different components that share prefix columns and whose
    overlap may reach the bound. Rows of ``prefixes``: h, cell, apart, block, node,
    component, n, rest (the columns beyond the prefix) and columns; what two rows share
    outside both prefixes is beyond the prefix of the one that ends first."""

    def multiply(key, table):
        h, cell, block, doc, comp, size_of, rest, columns = (
            np.asarray(table[c]) for c in ("h", "cell", "block", "node", "component", "n", "rest", "columns"))
        apart = np.asarray(table["apart"])
        nodes, at = np.unique(doc, return_index=True)
        by = np.lexsort((cell, h))
        cut = np.flatnonzero(np.r_[True, (h[by][1:] != h[by][:-1]) | (cell[by][1:] != cell[by][:-1])])
        found = []
        for lo, hi in zip(cut, np.r_[cut[1:], len(h)]):
            rows = by[lo:hi]
            some = column_pairs(doc[rows], comp[rows], block[rows], size_of[rows], columns[rows], percent, bool(apart[rows[0]]))
            found.append(doc[rows][some])
        size_of, rest = size_of[at], rest[at]
        if not sum(map(len, found)):
            return pa.table({"to": pa.array([], pa.int32()), "pairs": pa.array([], pa.binary())})
        pairs = np.sort(np.concatenate(found), axis=1)
        pairs, count = np.unique(pairs, axis=0, return_counts=True)
        place = np.searchsorted(nodes, pairs)
        n, beyond = size_of[place], rest[place].max(axis=1)
        near = 100 * n.min(axis=1) >= percent * n.max(axis=1)
        pairs, count, n, beyond = pairs[near], count[near], n[near], beyond[near]
        to = (mix(pairs[:, 0].view(np.uint64) * np.uint64(31) + pairs[:, 1].view(np.uint64)) % np.uint64(parts)).astype(int)
        # What the prefix columns must have in common for the overlap to reach percent (|x| + |y|) / (100 + percent).
        least = -(-percent * n.sum(axis=1) // (100 + percent)) - beyond
        rows = np.column_stack([pairs, count, least])
        return pa.table({"to": pa.array(np.unique(to), pa.int32()),
                         "pairs": pa.array([rows[to == t].tobytes() for t in np.unique(to)], pa.binary())})

    def accumulate(key, table):
        rows = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 4) for p in table["pairs"].to_pylist()])
        pairs, first, place = np.unique(rows[:, :2], axis=0, return_index=True, return_inverse=True)
        partial = np.bincount(place.reshape(-1), weights=rows[:, 2], minlength=len(pairs))
        able = partial >= rows[first, 3]
        return pa.table({"a": pairs[able, 0].copy(), "b": pairs[able, 1].copy()})

    binned = prefixes.withColumn("bin", F.pmod(F.xxhash64("h", "cell"), F.lit(4 * parts)))
    made = binned.groupBy("bin").applyInArrow(multiply, "to int, pairs binary")
    return made.groupBy("to").applyInArrow(accumulate, "a long, b long")


def in_cells(rows: DataFrame) -> DataFrame:
    """Rows of columns of up to ``m`` rows with the cells (pairs of blocks of rows) of
    their column that they are multiplied in: one for a column of up to ``COLUMN_ROWS``
    rows; a longer one is a square of blocks, whose cells are dealt on their own."""
    blocks = F.ceil(F.col("m") / F.lit(COLUMN_ROWS)).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return rows.withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).withColumn(
        "apart", F.col("block") != F.col("other")).drop("m", "blocks", "other")


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row that has a doc_id."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    parts = partitions(df)
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("h1"),
        F.xxhash64(whole, F.lit(4)).alias("h2"), whole.alias("text"))
    rows = materialize(incidence(docs, words, percent), as_table=True)
    sets = materialize(ordered_sets(rows, percent), as_table=True)

    slim = sets.select("node", "n", "share", "keys", F.size("hashes").cast("long").alias("columns"), (F.size("hashes") - F.col("prefix")).cast("long").alias("rest"), F.slice("hashes", F.lit(1), F.col("prefix")).alias("prefix_columns"))
    keyed = slim.select("node", "share", F.col("node").alias("component"), F.posexplode("keys").alias("j", "key"))
    links = materialize(linked(_to_centres(keyed, ["j", "key"]), sets, percent), as_table=True)
    found = components(links)
    for any_row in (False, True):
        by_column = _with_component(slim, found).select("node", "share", "component", F.explode("prefix_columns").alias("h"))
        links = materialize(links.union(linked(_to_centres(by_column, ["h"], any_row), sets, percent)), as_table=True)
        found = components(links)
    by_column = _with_component(slim, found).select("node", "component", "n", "rest", "columns", F.explode("prefix_columns").alias("h"))
    mixed = by_column.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where(
        "lo <> hi")
    able = products(in_cells(by_column.join(mixed.select("h", "m"), "h")), parts, percent)
    links = materialize(links.union(linked(able, sets, percent)), as_table=True)
    found = components(links)

    # A text's group: its component, or (a decimal number and 32 hex digits cannot be equal) its own set.
    texts = rows.select("h1", "h2", "n_shingles", "fingerprint", "node").join(found, "node", "left").select(
        "h1", "h2", "n_shingles", F.coalesce(F.col("component").cast("string"), F.hex("fingerprint")).alias("group"))
    out = materialize(docs.select("doc_id", "h1", "h2").join(texts, ["h1", "h2"]).drop("h1", "h2"), as_table=True)
    least = out.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return out.join(least, "group", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingles and a similarity of 0.75 or more."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))
