"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with hierarchical Dirichlet smoothing: with c the
counts of the training texts, P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and
P(w | context) = (c(context w) + m P(w | shorter context)) / (c(context) + m).
As an automaton (``Automaton``), every context seen in training is a state, every
n-gram seen is an arc that weighs P and leads to the longest context that ends
with it, and a state's failure arc leads to the next shorter context with the
weight m / (c(context) + m); the root has an arc for every word. Arc weights
include what the failure path would add, so a text is scored in one
left-to-right traversal that carries its state: take the arc of the next word if
the state has it, else fail; add the logarithms of the weights on the way.

The model of a corpus is as large as the corpus, so no task ever holds it. The
documents are dealt into batches of about 8 MB of text. Each batch
lists its distinct n-grams as sorted 64-bit hashes with their training counts
(0 for those that only held-out texts have) and sends contiguous ranges of the
list to the bins of the hash space; a bin adds the counts up and answers every
batch with totals in the order asked. From the answers the batch builds the part
of the automaton that its texts can reach: states, arcs and failure arcs. All
texts of a batch then walk in step, a word a step; a text of more than
``STRETCH`` words walks as several stretches at once, each of which first walks
the words before it that its state can depend on. A frequent n-gram costs one
entry a batch.

Rows: null text is empty (one end token); a row without doc_id takes no part
and is not returned; rows that repeat a doc_id each count and are each scored.
Texts may be of any length. Other columns are left out, whatever their names.
Without training tokens all counts are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .exchange import MESSAGE, answers, messages, number_of_batches, sums, totals
from .text import bound_batches, byte_values, mix, partitions, read_table, split_words, utf8, word_hashes

ORDER = 2
STRETCH = 512
WEIGHT = 100.0                  # m, the prior's weight in tokens
END = np.uint64(0x2545F4914F6CDD1D)
_VALUES = byte_values(lower=True, seed=5)


def tokens_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of consecutive texts, each closed by an end token, and where each text starts."""
    words = split_words(*utf8(column))
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(int(first[-1]), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = word_hashes(words, _VALUES)
    return out, first


def grams_of(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order``, the hash of the n-gram that ends at each
    token; before a text's start stands the end token."""
    grams, before = [tokens], tokens
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    for k in range(2, order + 1):
        before = np.r_[END, before[:-1]]
        before = np.where(place < k - 1, END, before)
        grams.append(mix(grams[-1] * np.uint64(0x9E6C63D0876A9A99) + mix(before) + np.uint64(k)))
    return grams


def _listed(column, held_out: np.ndarray, order: int):
    """Sorted distinct n-gram hashes of a batch, their training counts, and every n-gram's place in the list."""
    tokens, first = tokens_of(column)
    grams = grams_of(tokens, first, order)
    listed, place = np.unique(np.concatenate(grams), return_inverse=True)
    train = np.repeat(~held_out, np.diff(first))
    count = np.bincount(place, weights=np.tile(train, order), minlength=len(listed)).astype(np.int64)
    return listed, count, place.reshape(order, len(tokens)), first, train


class Automaton:
    """States, arcs and failure arcs for the n-grams of a batch.

    ``place[k][i]`` is the entry (in ``count``) of the n-gram of ``k + 1`` tokens that
    ends at token ``i``. State 0 is the root, state 1 + e the context of entry e, and
    the last states stand for a text's start, as contexts of one to ``order - 1`` end
    tokens, which occur as often as texts do.
    """

    def __init__(self, count: np.ndarray, place: np.ndarray, first: np.ndarray, z: float, weight: float):
        self.order, self.entries = len(place), len(count)
        inner = np.ones(place.shape[1], bool)
        inner[first[:-1]] = False                          # tokens that have one before them in their text
        texts = count[place[0][first[1] - 1]] if len(first) > 1 else 0.0
        starts = 1 + self.entries + np.arange(self.order - 1)
        self.start = int(starts[-1]) if self.order > 1 else 0
        seen_as = np.concatenate([[0.0], count, np.full(self.order - 1, texts)])     # c of a state's context
        self.fail = np.zeros(len(seen_as), np.int64)
        for k in range(1, self.order - 1):                 # contexts of k + 1 tokens fail to their last k
            self.fail[1 + place[k]] = np.where(count[place[k - 1]] > 0, 1 + place[k - 1], 0)
            self.fail[starts[k]] = starts[k - 1]
        self.fail_log = np.log10(weight / (seen_as + weight))
        # The probability of every entry's last token after the others.
        p = np.zeros(self.entries)
        p[place[0]] = (count[place[0]] + 0.5) / z
        keys, logs, to = [], [], []
        self.root_log, self.root_to = np.zeros(self.entries), np.zeros(self.entries, np.int64)
        for k in range(self.order):
            entry, at = np.unique(place[k], return_index=True)
            if k:
                # The context is the entry that ends at the token before; at a text's start, the start itself.
                before = np.where(inner[at], 1 + place[k - 1][at - 1], starts[k - 1])
                p[entry] = (count[entry] + weight * p[place[k - 1][at]]) / (seen_as[before] + weight)
            goes = 1 + (entry if k < self.order - 1 else place[max(k - 1, 0)][at])
            known = count[entry] > 0
            if k == 0:
                self.root_log[entry] = np.log10(p[entry])
                self.root_to[entry] = np.where(known & (self.order > 1), goes, 0)
            else:
                keys.append((before * self.entries + place[0][at])[known])
                logs.append(np.log10(p[entry])[known])
                to.append(goes[known])
        keys = np.concatenate(keys or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        self.key = keys[order]
        self.arc_log = np.concatenate(logs or [np.zeros(0)])[order]
        self.arc_to = np.concatenate(to or [np.zeros(0, np.int64)])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, added logarithms) of walks that read one word each."""
        state, added = state.copy(), np.zeros(len(state))
        out = np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            at_root = state[todo] == 0
            done = todo[at_root]
            added[done] += self.root_log[word[done]]
            out[done] = self.root_to[word[done]]
            todo = todo[~at_root]
            key = state[todo] * self.entries + word[todo]
            arc = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            has = self.key[arc] == key if len(self.key) else np.zeros(len(todo), bool)
            done, arc = todo[has], arc[has]
            added[done] += self.arc_log[arc]
            out[done] = self.arc_to[arc]
            todo = todo[~has]
            added[todo] += self.fail_log[state[todo]]
            state[todo] = self.fail[state[todo]]
        return out, added

    def walk(self, word: np.ndarray, first: np.ndarray, stretch: int | None = None) -> np.ndarray:
        """The logarithm of each text's probability; ``word`` holds the entries of the texts' tokens."""
        stretch = stretch or STRETCH
        n = np.diff(first)
        pieces = -(-n // stretch)
        text = np.repeat(np.arange(len(n)), pieces)
        begin = np.concatenate([np.arange(k) for k in pieces] or [np.zeros(0, np.int64)]) * stretch
        length = np.minimum(stretch, n[text] - begin)
        state = np.where(begin < max(1, self.order - 1), self.start, 0)
        for back in range(self.order - 1, 0, -1):          # stretches start from the words before them
            late = np.flatnonzero(begin >= back)
            if len(late):
                state[late], _ = self.step(state[late], word[first[text[late]] + begin[late] - back])
        total = np.zeros(len(text))
        order = np.argsort(-length, kind="stable")         # those still walking come first
        text, begin, length, state = text[order], begin[order], length[order], state[order]
        at = first[text] + begin
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, "left"))
            state[:live], added = self.step(state[:live], word[at[:live] + i])
            total[:live] += added
        out = np.zeros(len(n))
        np.add.at(out, text, total)
        return out


def vocabulary_size(docs: DataFrame, bins: int) -> tuple[int, int]:
    """(training tokens N, distinct training tokens V), over all rows."""

    def count(batches):
        for batch in batches:
            listed, n, _, _, _ = _listed(batch.column(1), np.asarray(batch.column(2)), 1)
            yield from messages(0, listed, n, bins).to_batches()

    def add(key, table):
        _, total = sums(table)
        return pa.table({"n": pa.array([int(total.sum())], pa.int64()), "v": pa.array([int((total > 0).sum())], pa.int64())})

    row = docs.mapInArrow(count, MESSAGE).groupBy("bin").applyInArrow(add, "n long, v long").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return row["n"] or 0, row["v"] or 0


def score(df: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
          weight: float = WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score):
    log10 probabilities of every text under the unigram base and under the
    model; both learn from the rows for which the expression ``held_out`` is false."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    docs = df.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        held_out.alias("held_out"))
    parts = partitions(df)
    batches = bins = number_of_batches(docs, "text", parts)
    n_train, n_distinct = vocabulary_size(docs, bins)
    z = n_train + 0.5 * (n_distinct + 1)
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))).repartition(parts, "batch")

    def ask(key, table):
        listed, count, _, _, _ = _listed(table["text"], np.asarray(table["held_out"]), order)
        return messages(key[0].as_py(), listed, count, bins)

    def traverse(key, texts, answered):
        _, _, place, first, _ = _listed(texts["text"], np.asarray(texts["held_out"]), order)
        count = totals(answered).astype(np.float64)
        starts = first[:-1]
        arc = count[place[0]]
        root = (arc + 0.5) / z
        model = Automaton(count, place, first, z, weight)
        total = lambda x: np.add.reduceat(x, starts)   # noqa: E731  every text has a token
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"],
            "n_tokens": pa.array(np.diff(first), pa.int64()),
            "n_known": pa.array(total((arc > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(first) - 1, n_train), pa.int64()),
            "base_score": pa.array(total(np.log10(root)), pa.float64()),
            "score": pa.array(model.walk(place[0], first), pa.float64())})

    asked = dealt.groupBy("batch").applyInArrow(ask, MESSAGE)
    return dealt.groupBy("batch").cogroup(answers(asked, parts).groupBy("batch")).applyInArrow(
        traverse, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                  "base_score double, score double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored by a model of the documents whose crc32 remainder is not 1."""
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1)
