"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A rollup is a folder of Parquet tables:

* ``states/batch=...``: what a batch made of each (doc_id, version) it touched
  (its source, language and count, or that it is gone), with the batch's number;
* ``deltas/batch=...``: the signed sums of the batch by source, language and
  version: minus the old state, plus the new one, of each document touched;
* ``commits``: one row a committed batch, appended last.

A batch id is any string, also an empty one; folders are named by its digest. A
batch without an id is an error.

Readers only see batches that ``commits`` lists, so totals are the sum of the
committed deltas. A batch that failed half-way is written anew when it is
repeated; a batch that is listed already changes nothing when it comes again.
Counts are additive, so totals never need the documents again.

Changes: ``op`` is insert, revise (both give the new source, language and
count) or delete; of several changes of a (doc_id, version) in one batch the one
with the largest ``seq`` holds, of equals the largest (op, source, lang,
n_tokens). Deleting what is not there changes nothing, and inserting what is
there revises it. Changes without op, doc_id or version, or with another op,
take no part; a null count is 0; null sources and languages are groups of their
own. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configured_checkpoint_dir, ensure_checkpoint_dir
from . import bpe
from .text import WORD_PATTERN, read_table

KEY = ["doc_id", "version"]
GROUP = ["source", "lang", "version"]
PIECES = r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+"
WITH_LETTER = r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*"


class TokenRollup:
    """The rollup in one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        empty = {
            "commits": "batch_id string, batch string, number long",
            "states": "doc_id long, version string, source string, lang string, n_tokens long, alive boolean, number long, batch string",
            "deltas": "source string, lang string, version string, docs long, tokens long, batch string",
        }
        for name, schema in empty.items():
            frame = spark.range(0).select(*(F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in schema.split(", "))))
            writer = frame.write.mode("ignore")
            (writer if name == "commits" else writer.partitionBy("batch")).parquet(f"{self.folder}/{name}")
        self.schema = empty

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema[name]).parquet(f"{self.folder}/{name}")

    def _committed(self, name: str) -> DataFrame:
        """Rows of the committed batches (the list has one short row a batch)."""
        return self._read(name).join(self._read("commits").select("batch").distinct(), "batch", "left_semi")

    def state(self) -> DataFrame:
        """The last state of every (doc_id, version), those that are gone included."""
        last = F.max(F.struct("number", "source", "lang", "n_tokens", "alive")).alias("s")
        return self._committed("states").groupBy(*KEY).agg(last).select(
            *KEY, "s.source", "s.lang", "s.n_tokens", "s.alive")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; false if it is committed already."""
        if batch_id is None:
            raise ValueError("a batch needs an id")
        done, batch = self._read("commits"), "b" + hashlib.sha256(batch_id.encode()).hexdigest()
        if not done.where(F.col("batch_id") == batch_id).isEmpty():
            return False
        number = (done.agg(F.max("number")).first()[0] or 0) + 1
        what = F.struct("seq", "op", F.col("source").cast("string").alias("source"),
                        F.col("lang").cast("string").alias("lang"),
                        F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        new = (changes.where(F.col("op").isin("insert", "revise", "delete") & F.col("doc_id").isNotNull()
                             & F.col("version").isNotNull())
               .select(F.col("doc_id").cast("long").alias("doc_id"), "version", what.alias("w"))
               .groupBy(*KEY).agg(F.max("w").alias("w"))
               .select(*KEY, "w.source", "w.lang", "w.n_tokens", (F.col("w.op") != "delete").alias("alive")))
        states = f"{self.folder}/states/batch={batch}"
        new.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(states)
        new = self.spark.read.parquet(states)
        signed = lambda rows, sign: rows.where("alive").select(
            *GROUP, F.lit(sign).alias("docs"), (F.col("n_tokens") * sign).alias("tokens"))
        before = self.state().join(new.select(*KEY), KEY, "left_semi")
        (signed(before, -1).union(signed(new, 1)).groupBy(*GROUP)
         .agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
         .where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}"))
        self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(batch).alias("batch"),
                                   F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of all documents that are there."""
        return self._committed("deltas").groupBy(*GROUP).agg(
            F.sum("docs").cast("long").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens")).where(
            "n_docs <> 0 or n_tokens <> 0")


def counts(docs: DataFrame, version: str, pattern: str, op: str = "insert", seq: int = 0) -> DataFrame:
    """Changes that set every document's count to the matches of a pattern in its whole text."""
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern))
    return docs.select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", "source", "lang",
                       F.lit(version).alias("version"), n.cast("long").alias("n_tokens"))


def bpe_counts(docs: DataFrame, version: str, vocabulary: str | None = None, op: str = "insert", seq: int = 0) -> DataFrame:
    """Changes that set every document's count to its tokens under a BPE vocabulary (``bpe.encode``)."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), vocabulary=vocabulary)
    return coded.select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", "source", "lang",
                        F.lit(version).alias("version"), "n_tokens")


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id): documents whose text a smaller doc_id has. Only texts that occur twice are joined back."""
    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    twice = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(twice, ["h1", "h2"]).where("doc_id > first").select("doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus's history: all documents come in under two tokenizer versions;
    the words of the first are revised (those without a letter or digit no longer
    count); documents with the text of a smaller doc_id are deleted; and the
    first batch is delivered a second time."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    folder = configured_checkpoint_dir(spark) or ensure_checkpoint_dir(spark)
    rollup = TokenRollup(spark, f"{folder.rstrip('/')}/rollups/{uuid.uuid4().hex}")
    words, pieces = counts(docs, "words-1", WORD_PATTERN), counts(docs, "pieces-1", PIECES)
    rollup.commit("words", words)
    rollup.commit("pieces", pieces)
    rollup.commit("revision", counts(docs, "words-1", WITH_LETTER, "revise"))
    copies = later_copies(docs)
    none = F.lit(None)
    rollup.commit("copies", copies.select(
        F.lit("delete").alias("op"), F.lit(0).alias("seq"), "doc_id", none.cast("string").alias("source"),
        none.cast("string").alias("lang"), F.explode(F.array(F.lit("words-1"), F.lit("pieces-1"))).alias("version"),
        none.cast("long").alias("n_tokens")))
    rollup.commit("words", words)
    return rollup.totals()


ORACLE_SQL = r"""
WITH first AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text),
kept AS (SELECT d.* FROM documents d JOIN first f ON d.doc_id = f.doc_id),
counted AS (
  SELECT source, lang, 'words-1' AS version,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]+')) FROM kept
)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang, version
"""
