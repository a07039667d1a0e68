import duckdb
from brute import SF
from compare import compare
from pyspark.sql import functions as F

from ledgerlens.llm import rollup

KIND = "op string, seq int, doc_id long, source string, lang string, version string, n_tokens long"


def totals(r):
    return {(x["source"], x["lang"], x["version"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    ok, why = compare(rollup.op10_token_counts(spark, SF), con, rollup.ORACLE_SQL)
    assert ok, why


def test_history(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "store"))
    batch = lambda *rows: spark.createDataFrame(rows, KIND).withColumn("alive", F.lit("clash"))
    assert totals(r) == {}
    first = batch(("insert", 1, 1, "a", "en", "v1", 10), ("insert", 1, 2, "a", "en", "v1", 5), ("insert", 1, 3, None, None, "v1", None),
                  ("insert", 1, 1, "a", "en", "v2", 7), ("noise", 1, 4, "a", "en", "v1", 99), (None, 1, 5, "a", "en", "v1", 9),
                  ("insert", 1, None, "a", "en", "v1", 1), ("insert", 1, 6, "a", "en", None, 1), ("delete", 1, 8, None, None, "v1", None))
    assert r.commit("b1", first)
    want = {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0), ("a", "en", "v2"): (1, 7)}
    assert totals(r) == want
    assert not r.commit("b1", first) and totals(r) == want
    # A revision that moves a document, two changes of one document, a repeated row, a deletion.
    assert r.commit("b2", batch(("revise", 1, 1, "b", "de", "v1", 12), ("revise", 1, 2, "a", "en", "v1", 6),
                                ("revise", 2, 2, "a", "en", "v1", 8), ("revise", 2, 2, "a", "en", "v1", 8),
                                ("delete", 1, 3, None, None, "v1", None)))
    assert totals(r) == {("b", "de", "v1"): (1, 12), ("a", "en", "v1"): (1, 8), ("a", "en", "v2"): (1, 7)}
    assert r.commit("b3", batch(("delete", 1, 1, None, None, "v1", None), ("insert", 2, 3, "c", "fr", "v1", 4)))
    assert totals(r) == {("a", "en", "v1"): (1, 8), ("a", "en", "v2"): (1, 7), ("c", "fr", "v1"): (1, 4)}
    assert r.commit("empty", batch(("insert", 1, 1, "a", "en", "v1", 1)).where("false"))
    again = rollup.TokenRollup(spark, str(tmp_path / "store"))
    assert totals(again)[("c", "fr", "v1")] == (1, 4) and not again.commit("b2", first)


def test_a_batch_that_failed_half_way_is_not_seen_and_can_be_repeated(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("insert", 1, 1, "a", "en", "v1", 10)], KIND)
    spark.createDataFrame([(1, "v1", "a", "en", 99, True, 1)],
                          "doc_id long, version string, source string, lang string, n_tokens long, alive boolean, number long"
                          ).write.parquet(f"{r.folder}/states/batch=b1")
    spark.createDataFrame([("a", "en", "v1", 1, 99)], "source string, lang string, version string, docs long, tokens long"
                          ).write.parquet(f"{r.folder}/deltas/batch=b1")
    assert totals(r) == {}
    assert r.commit("b1", rows) and totals(r) == {("a", "en", "v1"): (1, 10)}


def test_any_string_is_a_batch_id(spark, tmp_path):
    """Ids that a path would change, equal ids but for case, and the empty one: each counts once and none is lost."""
    import pytest
    r = rollup.TokenRollup(spark, str(tmp_path / "store"))
    ids = ["a%20b", "a b", "2026/12/03", "x=y", "", ".", "..", "007", "7", "B", "b", "ü", "a" * 400, "batch=__HIVE_DEFAULT_PARTITION__"]
    for i, batch in enumerate(ids):
        rows = spark.createDataFrame([("insert", 1, i, "a", "en", "v1", 10)], KIND)
        assert r.commit(batch, rows) and not r.commit(batch, rows)
    assert totals(r) == {("a", "en", "v1"): (len(ids), 10 * len(ids))}
    assert totals(rollup.TokenRollup(spark, r.folder)) == totals(r)
    with pytest.raises(ValueError):
        r.commit(None, rows)


def test_tokens_of_a_tokenizer(spark, tmp_path):
    """A version whose counts come from BPE, against the tokenizers library, with a revision and a deletion."""
    import pytest
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    r = rollup.TokenRollup(spark, str(tmp_path / "store"))
    r.commit("all", rollup.bpe_counts(docs, "bpe-49k"))
    r.commit("shorter", rollup.bpe_counts(docs.where("doc_id % 3 = 0").withColumn("text", F.substring("text", 1, 50)), "bpe-49k", op="revise"))
    r.commit("gone", rollup.bpe_counts(docs.where("doc_id % 7 = 0"), "bpe-49k", op="delete"))
    want = {}
    for x in docs.collect():
        if x["doc_id"] % 7:
            text = (x["text"] or "")[:50] if x["doc_id"] % 3 == 0 else x["text"] or ""
            n, t = want.get((x["source"], x["lang"], "bpe-49k"), (0, 0))
            want[x["source"], x["lang"], "bpe-49k"] = n + 1, t + len(library.encode(text, add_special_tokens=False).ids)
    assert totals(r) == want


def test_later_copies(spark):
    rows = [(3, "same"), (1, "same"), (2, "other"), (4, None), (5, None), (None, "same"), (9, "same"), (9, "same")]
    got = rollup.later_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in got.collect()) == [3, 5, 9, 9]


def test_empty_documents(spark, tmp_path):
    r = rollup.TokenRollup(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert r.commit("none", rollup.counts(none, "words-1", rollup.WORD_PATTERN)) and totals(r) == {}
