"""Against the tokenizers library, on documents and on odd strings."""

import hashlib
import random

import numpy as np
import pytest
from brute import documents, empty

from ledgerlens.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def coder():
    return bpe.TrieCoder(open(public.path("word_bpe_49k.json"), encoding="utf-8").read())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_strings(coder, library):
    draw = random.Random(1)
    odd = ["", "İSTANBUL ΣΑΣ's I'LL don't 's x\x1cy \x85a b 12 ½ ² <|endoftext|> a<|startoftext|>b <|x|> 日本語 👍🏽 é ﬁ Ǆ ẞ </w>",
           "a" * 3000, "\x00\x01\x7f", "<|endoftext|><|endoftext|>"]
    odd += ["".join(draw.choice("etaoinshrdlu'") for _ in range(draw.randrange(1, 30))) for _ in range(3000)]
    odd += ["".join(chr(draw.choice((draw.randrange(32, 127), draw.randrange(161, 0x24F), draw.randrange(0x391, 0x3C9))))
                    for _ in range(draw.randrange(1, 40))) for _ in range(1500)]
    for text, got, want in zip(odd, coder.encode(odd), library.encode_batch(odd, add_special_tokens=False)):
        assert ids(got) == want.ids, text
        assert coder.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_small_caches_do_not_matter(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    small = bpe.TrieCoder(open(public.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = [" ".join(f"{w}{i}" for w in ("thering", "ouable", "Éclair")) for i in range(300)]
    for _ in range(2):
        assert [ids(x) for x in small.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_documents_and_clashing_columns(spark, library):
    df = documents(spark, {"N_Tokens": "string", "decoded": "int", "extra": "int"})
    out = bpe.encode(df, decoded=True)
    assert set(out.columns) == {"doc_id", "text", "extra", "n_tokens", "token_ids", "decoded"}
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert ids(r["token_ids"]) == want and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert [r["decoded"] for r in bpe.decode(out.select("doc_id", "token_ids")).collect()] == [r["decoded"] for r in rows]
    assert bpe.encode(empty(spark)).count() == 0


def test_query(spark, library):
    for r in bpe.op9_bpe(spark, "/root/testdata/sf0.001").join(
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").limit(50).collect():
        want = library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_two_vocabularies_in_one_session(spark, library, tmp_path):
    """A worker's coder belongs to the vocabulary it was made from."""
    import json
    model = json.load(open(public.path("word_bpe_49k.json"), encoding="utf-8"))
    model["model"]["merges"] = model["model"]["merges"][:300]
    other = tmp_path / "few.json"
    other.write_text(json.dumps(model), encoding="utf-8")
    few = tokenizers.Tokenizer.from_file(str(other))
    df = spark.createDataFrame([(i, f"Thering {i} ouable naïve 👍") for i in range(40)], "doc_id long, text string").repartition(4)
    for _ in range(2):
        for path, lib in ((None, library), (str(other), few)):
            for r in bpe.encode(df, vocabulary=path, decoded=True).collect():
                want = lib.encode(r["text"], add_special_tokens=False).ids
                assert ids(r["token_ids"]) == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)


def test_a_very_long_text(coder, library):
    text = " ".join(f"lérem{i % 977} ipsum, ({i})" for i in range(60_000))
    got = coder.encode([text, "", text[:100]])
    assert ids(got[0]) == library.encode(text, add_special_tokens=False).ids and got[1] == b""
    assert coder.decode_all(got).to_pylist() == [library.decode(ids(x), skip_special_tokens=False) for x in got]


def test_unknown_ids_are_an_error(coder):
    with pytest.raises((KeyError, IndexError)):
        coder.decode(np.array([10_000_000], "<u4").tobytes())
