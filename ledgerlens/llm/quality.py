"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Every passage of every
text is encoded: shares of byte classes, word-length moments, letter case and
repetition at several distances make its features, a learned tanh layer its
representation. Labels belong to documents, not to passages, so the model
learns gated attention (Ilse, Tomczak and Welling, 2018): a passage weighs
softmax(w . (tanh(V h) * sigmoid(U h))) within its document, and the document's
score is the logistic of a linear form of the weighted sum of representations.

The fit uses at most ``TRAIN_DOCS`` labelled documents (half of each label, by
hash of doc_id; fewer where there are fewer) and of these at most
``TRAIN_PASSAGES`` evenly spread passages each; it runs in one task, and its
result is a few thousand numbers. Scoring covers all passages of all texts, in
one pass without a shuffle.

Rows: null and empty texts are bags of one empty passage; labels that are null
or contradict each other for a doc_id are not learnt from; rows without doc_id
are scored (``held_out`` is null) and not learnt from; repeated rows are scored
alike. Without labels of both kinds every score is the share of label 1 among
the labels there are (0.5 without any). Columns ``held_out``, ``score`` and
``predicted`` are replaced; all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .text import add_columns, bound_batches, byte_values, pieces, read_table, split_words, utf8, word_hashes

PASSAGE = 64
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 32
PIECE = 1 << 20                 # bytes of text worked on at a time; passages of a piece take some 20 times as much memory
HIDDEN, GATES = 16, 8
STEPS, RATE, DECAY = 250, 0.03, 1e-4
THRESHOLD = 0.7
LAGS = (1, 2, 3, 4, 8, 16)

# Byte classes: lower case, upper case, digits, blanks, line ends, each other ASCII byte by itself, the rest.
_CLASS = np.zeros(256, np.int64)
_single = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C]], _CLASS[[0x0A, 0x0D]] = 3, 4
_CLASS[_single] = np.arange(5, 5 + len(_single))
_CLASS[128:] = 5 + len(_single)
_CLASS[[b for b in range(33) if b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)] + [127]] = 6 + len(_single)
CLASSES = 7 + len(_single)
FEATURES = CLASSES + 5 + len(LAGS)
_VALUES = byte_values(lower=False, seed=8)


def passages(column) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a batch of texts, and where each text's passages start (one at least)."""
    raw, at = utf8(column)
    words = split_words(raw, at)
    n = len(at) - 1
    count = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.r_[0, np.cumsum(count)]
    total = int(first[-1])
    place = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
    owner = np.repeat(first[:-1], words.counts) + place // PASSAGE
    opens = np.flatnonzero(place % PASSAGE == 0)
    # A passage's bytes run from its first word to the next passage's first word.
    edge = np.full(total + 1, len(raw), np.int64)
    edge[first[:-1]] = at[:-1]
    edge[owner[opens]] = np.where(place[opens] == 0, at[:-1][words.text[opens]], words.start[opens])
    size = np.maximum(np.diff(edge), 0)
    cell = np.repeat(np.arange(total) * CLASSES, size) + _CLASS[raw]
    shares = np.bincount(cell, minlength=total * CLASSES).reshape(total, CLASSES) / np.maximum(size, 1)[:, None]
    per = lambda x: np.bincount(owner, weights=x, minlength=total)
    n_words = np.bincount(owner, minlength=total)
    some = np.maximum(n_words, 1)
    length = (words.end - words.start).astype(float)
    mean = per(length) / some
    spread = np.sqrt(np.maximum(per(length ** 2) / some - mean ** 2, 0))
    head = _CLASS[raw[words.start]] if len(words) else np.zeros(0)
    tail = _CLASS[raw[words.end - 1]] if len(words) else np.zeros(0)
    out = [np.log1p(mean), np.log1p(spread), per(head == 1) / some, per(tail > 4) / some, n_words / PASSAGE]
    hashes = word_hashes(words, _VALUES)
    for lag in LAGS:
        same = np.zeros(len(words), bool)
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (place[lag:] >= lag) if len(words) > lag else False
        out.append(per(same) / some)
    return np.column_stack([np.sqrt(shares), *out]).astype(np.float32), first


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


class AttentionModel:
    """Gated attention over the passages of a document; parameters are plain arrays."""

    NAMES = ("encode", "encode_0", "v", "u", "w", "c", "c_0")

    def __init__(self, parameters: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = parameters, mean, scale

    @classmethod
    def start(cls, x: np.ndarray, seed: int = 8) -> "AttentionModel":
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        p = {"encode": draw(x.shape[1], HIDDEN), "encode_0": np.zeros(HIDDEN), "v": draw(HIDDEN, GATES),
             "u": draw(HIDDEN, GATES), "w": draw(GATES, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "c_0": np.zeros(1)}
        return cls(p, x.mean(axis=0), x.std(axis=0) + 0.02)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        x = x - self.mean
        x /= self.scale
        np.clip(x, -6, 6, out=x)
        h = np.tanh(x @ p["encode"] + p["encode_0"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(s - np.maximum.reduceat(s, first[:-1])[bag])
        a = e / _sums(e, first)[bag]
        z = _sums(a[:, None] * h, first)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag,
                "score": 1 / (1 + np.exp(-(z @ p["c"] + p["c_0"][0])))}

    def gradient(self, f: dict, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, bag, h, a = self.p, f["bag"], f["h"], f["a"]
        d = (f["score"] - y) * weight
        dz = d[:, None] * p["c"]
        da = (h * dz[bag]).sum(axis=1)
        ds = a * (da - _sums(a * da, first)[bag])
        dv, du = ds[:, None] * p["w"] * f["u"], ds[:, None] * p["w"] * f["v"]
        dv, du = dv * (1 - f["v"] ** 2), du * f["u"] * (1 - f["u"])
        dh = a[:, None] * dz[bag] + dv @ p["v"].T + du @ p["u"].T
        dh *= 1 - h ** 2
        return {"encode": f["x"].T @ dh, "encode_0": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du,
                "w": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ d, "c_0": np.array([d.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> "AttentionModel":
        """Adam on the logistic loss; both labels weigh the same."""
        ones = y.mean()
        weight = np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones)) / len(y)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, STEPS + 1):
            g = self.gradient(self.forward(x, first), first, y, weight)
            for k in self.p:
                grad = g[k] + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad ** 2
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        return self

    def to_row(self) -> dict[str, list]:
        return {**{k: self.p[k].reshape(-1).tolist() for k in self.NAMES},
                "mean": self.mean.tolist(), "scale": self.scale.tolist()}

    @classmethod
    def from_row(cls, row) -> "AttentionModel":
        shape = {"encode": (FEATURES, HIDDEN), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES)}
        return cls({k: np.array(row[k]).reshape(shape.get(k, -1)) for k in cls.NAMES},
                   np.array(row["mean"]), np.array(row["scale"]))


def training_rows(labels: DataFrame, held_out, doc_id: str, label: str, most: int) -> DataFrame:
    """(doc_id, label) of the bounded sample to learn from."""
    clear = (labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
             .groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
             .where("label = other").where(~held_out(F.col("doc_id"))).select("doc_id", "label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = [clear.where(F.col("label") == k).orderBy(*by_hash).limit(most // 2) for k in (0, 1)]
    return half[0].union(half[1])


def fit(df: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text"):
    """The model learnt from the documents of a bounded sample, or the score to give without one."""
    share = sample.agg(F.avg("label"), F.count("label"), F.min("label"), F.max("label")).first()
    if share[1] == 0 or share[2] == share[3]:
        return float(share[0] if share[0] is not None else 0.5)
    # At most TRAIN_DOCS rows of two numbers: small whatever the input.
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")

    def features(batches):
        for batch in batches:
            for a, b in pieces(utf8(batch.column(1))[1], PIECE):
                x, first = passages(batch.column(1).slice(a, b - a))
                rows = []
                for i in range(b - a):
                    n = first[i + 1] - first[i]
                    use = first[i] + np.unique(np.linspace(0, n - 1, min(n, TRAIN_PASSAGES)).astype(int))
                    rows.append(x[use].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a).cast(pa.int32()),
                     pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    def learn(key, table):
        packed, ids = table["x"].to_pylist(), table["doc_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], packed[i]))
        rows = [np.frombuffer(r, np.float32).reshape(-1, FEATURES).astype(float) for r in packed]
        x = np.concatenate([rows[i] for i in order])
        first = np.r_[0, np.cumsum([len(rows[i]) for i in order])]
        row = AttentionModel.start(x).fit(x, first, np.asarray(table["label"])[order].astype(float)).to_row()
        return pa.table({k: pa.array([v], pa.list_(pa.float64())) for k, v in row.items()})

    schema = T.StructType([T.StructField(k, T.ArrayType(T.DoubleType())) for k in (*AttentionModel.NAMES, "mean", "scale")])
    found = docs.mapInArrow(features, "doc_id long, label int, x binary").groupBy().applyInArrow(learn, schema)
    row = found.first()
    return AttentionModel.from_row(row) if row is not None else float(share[0])


def scores_of(model, column) -> np.ndarray:
    """The scores of a batch of texts, a piece at a time."""
    out = [np.zeros(0)]
    for a, b in pieces(utf8(column)[1], PIECE):
        if isinstance(model, float):
            out.append(np.full(b - a, model))
        else:
            out.append(model.forward(*passages(column.slice(a, b - a)))["score"])
    return np.concatenate(out)


def score(df: DataFrame, model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""
    ship_package(df.sparkSession)

    def build(batch):
        s = scores_of(model, batch.column(batch.schema.get_field_index(text)))
        return [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())]

    return add_columns(df, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], build)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality", most: int = TRAIN_DOCS) -> DataFrame:
    """``df`` with ``held_out``, ``score`` and ``predicted``, learnt from the labels that are not held out."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    sample = training_rows(labels, held_out, doc_id, label, most)
    return score(df.withColumn("held_out", held_out(F.col(doc_id))), fit(df, sample, doc_id, text), text)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored for quality."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
