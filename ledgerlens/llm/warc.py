"""WARC archives with a Zstandard dictionary of their own.

A file begins with a skippable frame that holds a dictionary built from the file's
first records; then every record is a frame by itself, so that one record can be
read without the others. Spark's text writer makes the files, so they can lie in
any store that Spark writes to and appear by its commit: a *line* is the frames of
about ``LINE_BYTES``, and the line feed after it is the content of a one-byte
skippable frame whose head ends the line, which leaves a plain Zstandard file.
``LINES`` lines make a file, so its size is bounded (a longer record makes a longer
line), and a task holds one line and the records that the dictionary is built from.

Of records with equal payloads the one with the largest page_id is a response; the
others are revisits that name it, with the HTTP head and no payload. Payloads are
compared by SHA-1 and size. Only payloads that occur twice are joined back to the
pages; the planner broadcasts them if they are small, else AQE splits a hot one.

Reading walks the frames by their block heads, and recomputes every response's
digest; a difference is an error.

Rows: null html is an empty payload; a null url has no target and stays null; a url
that holds more than printable ASCII is percent-encoded as a target and given once
more as it is. Rows that repeat the largest page_id of their payload are all
responses, and so are rows of a payload that has no page_id at all; other rows
without page_id are revisits. Other columns are left out. Empty tables make no record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections import deque

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, ship_package
from .text import bound_batches, read_table

LINE_BYTES = 1 << 20             # of frames
LINES = 32                       # a file
SAMPLE_BYTES = 2 << 20           # of a file's records, for its dictionary
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
READ_BYTES = 8 << 20             # of payloads returned at once

# Magic numbers of a Zstandard frame, of skippable frames and of the one that holds a dictionary.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
LINE_END = struct.pack("<II", SKIPPABLE, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLAIN_URL = re.compile(rb"[\x21-\x7e]+")
RECORDS = ("record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
           "refers_to long")


def _named(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def _page(urn: str | None) -> int | None:
    got = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(got[1]) if got else None


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: bytes | None, payload: bytes, digest: str, refers_to: int | None, date: str,
           spare: str) -> bytes:
    """A response, or with ``refers_to`` a revisit. ``spare`` names a record that has no page_id."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", date),
              ("WARC-Record-ID", f"<urn:uuid:{spare}>" if page_id is None else _named(page_id))]
    if url is not None:
        plain = PLAIN_URL.fullmatch(url)
        fields.append(("WARC-Target-URI", url.decode() if plain else "".join(
            chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in url)))
        if not plain:
            fields.append(("X-Page-URL", json.dumps(url.decode("utf-8", "replace"))))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
               ("Content-Length", str(len(block)))]
    return _head(fields) + block + b"\r\n\r\n"


def info(date: str) -> bytes:
    """The record that says what a file is."""
    block = b"format: WARC File Format 1.1\r\n"
    return _head([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=0)}>"),
                  ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; where they are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(r[:DICTIONARY_BYTES] for r in records)[:DICTIONARY_BYTES],
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def lines(records, date: str):
    """The lines of a task's files: every ``LINES`` of them begin with a dictionary."""
    records, queue = iter(records), deque()
    while True:
        size = sum(map(len, queue))
        while size < SAMPLE_BYTES and (one := next(records, None)) is not None:
            queue.append(one)
            size += len(one)
        if not queue:
            return
        squeeze, line = _opened(list(queue), date)
        made = 1
        yield line + LINE_END
        line = bytearray()
        while made < LINES and (one := queue.popleft() if queue else next(records, None)) is not None:
            line += squeeze(one)
            if len(line) >= LINE_BYTES:
                yield bytes(line) + LINE_END
                made, line = made + 1, bytearray()
        if line:
            yield bytes(line) + LINE_END


def _opened(held: list[bytes], date: str):
    """The compressor of a new file, and the frames that the file begins with."""
    known = build_dictionary(held)
    data = known.as_bytes()
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True).compress
    return squeeze, struct.pack("<II", DICTIONARY, len(data)) + data + squeeze(info(date))


def frames(data: memoryview):
    """(magic number, start, end) of every frame of a file."""
    at = 0
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            yield magic, at, at + 8 + size
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no Zstandard frame at byte {at}")
        head = bytes(data[at:at + 18])
        to = at + zstandard.frame_header_size(head)
        while True:
            block = int.from_bytes(data[to:to + 3], "little")
            to += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        to += 4 * zstandard.get_frame_parameters(head).has_checksum
        yield magic, at, to
        at = to


def records(data: memoryview):
    """The decompressed records of a file."""
    unpack = None
    for magic, start, end in frames(data):
        if magic == DICTIONARY and unpack is None:
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[start + 8:end]))).decompress
        elif magic == FRAME:
            yield (unpack or zstandard.ZstdDecompressor().decompress)(bytes(data[start:end]))


def parse(one: bytes) -> tuple | None:
    """(record_type, page_id, url, payload, payload_bytes, payload_digest, refers_to); none for a record of another type."""
    head, _, rest = one.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].partition(":")[2]
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or found != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: payload of {len(payload)} bytes, digest {found}; "
                             f"its head says {size} and {digest}")
    url = json.loads(fields["X-Page-URL"]) if "X-Page-URL" in fields else fields.get("WARC-Target-URI")
    return (kind, _page(fields["WARC-Record-ID"]), url, payload if kind == "response" else None, size, digest,
            _page(fields.get("WARC-Refers-To")))


def with_kept(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, kept): ``kept`` is the page_id of the response
    that holds the payload of a row, null where no other row has it."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    twice = rows.where(F.col("size") >= revisit_from).groupBy("digest", "size").agg(
        F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(materialize(twice, as_table=True), ["digest", "size"], "left").select(
        "page_id", "url", "payload", "digest", "kept")


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as archives under a new folder of any store
    that Spark writes to; payloads of fewer than ``revisit_from`` bytes are never revisits."""
    ship_package(pages.sparkSession)
    bound_batches(pages.sparkSession)

    def made(batches):
        no = 0
        for batch in batches:
            page, _, _, digests, kept = (c.to_pylist() if i in (0, 3, 4) else None for i, c in enumerate(batch.columns))
            urls = batch.column(1).cast(pa.binary())
            for i, (p, d, k) in enumerate(zip(page, digests, kept)):
                spare = uuid.UUID(int=TaskContext.get().partitionId() << 64 | no)
                no += 1
                yield record(p, urls[i].as_py(), batch.column(2)[i].as_py(), base64.b32encode(bytes.fromhex(d)).decode(),
                             k if k is not None and k != p else None, date, str(spare))

    def run(batches):
        for line in lines(made(batches), date):
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], names=["value"])

    found = with_kept(pages, revisit_from).mapInArrow(run, "value binary")
    found.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").option(
        "maxRecordsPerFile", LINES).text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every page record of the archives in a folder; without ``payloads``, that column is null (they are checked all the same)."""
    ship_package(spark)
    bound_batches(spark)
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        rows, size = [], 0
        for one in batches:
            for content in one.column(0):
                for data in records(memoryview(content.as_buffer())):
                    got = parse(data)
                    if got is None:
                        continue
                    rows.append(got if payloads else (*got[:3], None, *got[4:]))
                    size += 500 + (len(got[3] or b"") if payloads else 0)
                    if size >= READ_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p GROUP BY d),
bits AS (SELECT p.*, k.kept, list_transform(range(8), lambda g: CAST('0x' || substr(p.d, 5 * g + 1, 5) AS BIGINT)) AS twenty FROM p JOIN k USING (d))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((twenty[i // 4 + 1] // [32768, 1024, 32, 1][i % 4 + 1]) % 32 AS BIGINT) + 1, 1)), '')
         AS payload_digest,
       CASE WHEN kept IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept IS NULL OR page_id = kept THEN NULL ELSE kept END AS refers_to
FROM bits
"""
