import base64
import glob
import hashlib

import duckdb
import pytest
import zstandard
from brute import SF, empty
from compare import compare
from pyspark.sql import functions as F

from ledgerlens.llm import warc

KIND = "page_id long, url string, html string"


def page_rows():
    base = "<html><body>" + "shared words of a page " * 40
    out = [(i, f"http://a.example/{i}", f"{base}{i}</body></html>") for i in range(300)]
    out += [(1000 + i, f"http://b.example/{i}", base) for i in range(200)]                  # a hot payload
    out += [(2000, None, None), (2001, "", ""), (2002, "http://x/ä b\r\nWARC-Type: x", "naïve\r\n\r\nWARC/1.1"), (2003, "u", "x" * 3_000_000),
            (2004, "u", "x" * 3_000_000), (None, "n", "no id"), (None, "n2", "no id"), (None, "n3", base), (1199, "again", base),
            (-5, "http://minus", "minus"), (2**62, "big", "minus")]
    return out


def brute(rows, revisit_from=0):
    found = [(p, u, (h or "").encode()) for p, u, h in rows]
    kept = {}
    for p, _, h in found:
        kept.setdefault(h, []).append(p)
    out = []
    for p, u, h in found:
        ids = [x for x in kept[h] if x is not None]
        k = max(ids) if ids and len(h) >= revisit_from else None
        response = k is None or p == k
        out.append((p, u, h if response else None, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(),
                    "response" if response else "revisit", None if response else k))
    return sorted(out, key=str)


def read(df):
    return sorted(((r["page_id"], r["url"], None if r["payload"] is None else bytes(r["payload"]), r["payload_bytes"],
                    r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("revisit_from", [0, 1, 1000])
def test_round_trip(spark, tmp_path, revisit_from):
    pages = spark.createDataFrame(page_rows(), KIND).repartition(3).withColumn("payload", F.lit(1)).withColumn("digest", F.lit("clash"))
    warc.write_archives(pages, str(tmp_path / "out"), revisit_from)
    assert read(warc.read_archives(spark, str(tmp_path / "out"))) == brute(page_rows(), revisit_from)


def test_files_are_plain_zstandard_with_the_dictionary_first(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(page_rows(), KIND).coalesce(1), str(tmp_path / "out"))
    files = glob.glob(f"{tmp_path}/out/part-*")
    assert files
    for path in files:
        data = open(path, "rb").read()
        size = int.from_bytes(data[4:8], "little")
        assert data[:4] == b"\x5d\x2a\x4d\x18" and data[8:12] == b"\x37\xa4\x30\xec"     # a trained dictionary
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        with plain.stream_reader(data, read_across_frames=True) as reader:
            text = reader.read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.endswith(b"\r\n\r\n")
        frames = sum(m == warc.FRAME for m, _, _ in warc.frames(memoryview(data)))
        assert text.count(b"WARC-Type: ") == frames + 1          # one more stands in a url
        assert len(data) < 0.05 * len(text)


def test_files_of_several_lines_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINE_BYTES", 300)
    monkeypatch.setattr(warc, "LINES", 4)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 3000)
    made = [warc.record(i, b"u", hashlib.sha512(str(i).encode()).hexdigest().encode() * (i % 7), "D", None, "now", "0") for i in range(400)]
    found = list(warc.lines(made, "now"))
    got = []
    for at in range(0, len(found), 4):
        data = b"".join(x + b"\n" for x in found[at:at + 4])
        one = list(warc.records(memoryview(data)))
        assert one[0] == warc.info("now")
        got += one[1:]
    assert got == made
    assert list(warc.lines([], "now")) == []


def test_a_changed_payload_is_an_error():
    one = warc.record(1, b"u", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, "now", "0")
    assert warc.parse(one)[:2] == ("response", 1)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(one.replace(b"abc", b"abd"))


def test_empty(spark, tmp_path):
    warc.write_archives(empty(spark, KIND), str(tmp_path / "out"))
    assert read(warc.read_archives(spark, str(tmp_path / "out"))) == []


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    ok, why = compare(warc.op13_warc(spark, SF), con, warc.ORACLE_SQL)
    assert ok, why
