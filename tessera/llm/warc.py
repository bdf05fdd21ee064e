"""WARC archives, compressed record by record with a Zstandard dictionary built from archived records.

Archive layout: one file for each task::

    skippable frame 0x184D2A5D with the dictionary, then for each record
    a Zstandard frame (the record, compressed with the dictionary) and
    a skippable frame 0x184D2A5E of one byte, which is a line feed

Readers skip the second kind. It is there because archives are written by Spark's text writer, a record a line: the
writer's line feed is that byte. So archives reach any file system Spark reaches, through its commit protocol, and a
record can be read alone given the dictionary and its offset. A record with a payload that an earlier page (by id)
already has is a revisit without payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_bound, map_batches, materialize, scratch_path, skew_join

DICTIONARY_MAGIC, MARK_MAGIC = 0x184D2A5D, 0x184D2A5E
MARK = struct.pack("<II", MARK_MAGIC, 1)
#: Payloads below this size are always stored.
MIN_REVISIT_BYTES = 100
#: Slices of records that the dictionary is built from at most, bytes of each, and bytes of the dictionary.
SAMPLE_SLICES, SLICE_BYTES, DICTIONARY_BYTES = 1000, 8 << 10, 64 << 10
#: Payload bytes of an archive, and what a record without payload counts for.
FILE_BYTES, RECORD_BYTES = 64 << 20, 512
#: Groups over which rows that repeat one payload without an id are dealt.
SALTS = 64
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int, date: str = DATE) -> bytes:
    """One WARC/1.1 record. ``refers_to`` makes it a revisit, whose block has HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; too few samples to train on serve as they are; none give an empty one."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def sampled_records(rows: DataFrame, told: DataFrame, n: int, most: int = SAMPLE_SLICES, width: int = SLICE_BYTES) -> list[bytes]:
    """Slices of records for the dictionary: at most ``most`` of ``width`` payload bytes, the first of a record with its
    headers. ``rows`` is ``with_payload``'s, ``told`` names the revisits, ``n`` rows are stored whole. Records of any size are
    candidates, chosen by a hash of id and address; if there are fewer than ``most``, long ones give more slices, from
    their beginning on. They are cut on the executors, so the driver gets at most ``most * width`` bytes and headers."""
    o = F.xxhash64("page_id", "url", F.lit(7))
    near = rows.where(o <= hash_bound(1.2 * most / max(n, 1))).withColumn("o", o).join(told, KEY, "left_anti")
    last = F.least(F.lit(max(1, most // max(n, 1)) - 1), F.floor(F.col("size") / width).cast("int"))
    cut = near.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.select("page_id", "url", F.lower(F.hex("digest")).alias("digest"), "o", "k", "size", F.substring("payload", F.col("k") * width + 1, F.lit(width)).alias("part"))
    picked = cut.orderBy("o", "page_id", "digest", "k").limit(most).collect()
    head = lambda r: record(r["page_id"], r["url"], b"", r["digest"], None, r["size"])[:-4]  # noqa: E731  without the end mark
    return [(b"" if r["k"] else head(r)) + bytes(r["part"]) for r in picked]


#: What tells rows apart that have one verdict: id (empty for none), digest, and a salt for rows without an id.
KEY = ["own", "digest", "salt"]


def own_key() -> Column:
    return F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("own")


def with_payload(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, size`` of each page; null html is empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload").cast("long"))


def revisits(slim: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, digest, refers_to``, distinct, of pages that revisit another, from rows ``page_id, digest, size`` (a table).
    Payloads take no part; rows of a common digest are dealt over many tasks."""
    again = slim.where(F.col("size") >= min_bytes)
    first = again.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    pairs = again.select("page_id", "digest").distinct()
    found = skew_join(pairs, first, "digest", "n", slim.count(), ["page_id"], "inner")
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> None:
    """Write the records of ``pages`` to archives of about ``file_bytes`` payload bytes, one for each partition. Payloads are
    shuffled once, by id and digest (and address, where there is no id)."""
    rows = with_payload(pages)
    slim = materialize(rows.select("page_id", "digest", "size"), "warc-digests")
    n, total = slim.agg(F.count("*"), F.sum(F.col("size") + RECORD_BYTES)).first()
    told = revisits(slim, min_bytes)
    told = told.withColumn("salt", F.explode(F.when(F.col("page_id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    told = materialize(told.select(own_key(), "digest", "salt", "refers_to"), "warc-revisits")
    rows = rows.withColumn("salt", F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url"), F.lit(SALTS))).otherwise(0).cast("int")).withColumn("own", own_key())
    dictionary = build_dictionary(sampled_records(rows, told, n - told.where("salt = 0").count()))
    dealt = rows.repartition(max(1, -(-(total or 0) // file_bytes)), *KEY).join(told, KEY, "left")
    out = dealt.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.lower(F.hex("digest")).alias("digest"), "size", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, size, refers = (c[i].as_py() for c in batch.columns)
                line = lead + compressor.compress(record(page, url, payload or b"", digest, refers, size)) + MARK
                lead = b""
                yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], ["value"])

    map_batches(out, run, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)


def read_records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with its dictionary")
    at, dictionary = 8 + size, content[8 : 8 + size]
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(content)
    while at < len(content):
        stream = decompressor.decompressobj()
        data = [stream.decompress(view[at : at + 65536])]
        end = min(at + 65536, len(content))
        while not stream.eof:
            data.append(stream.decompress(view[end : end + 65536]))
            end = min(end + 65536, len(content))
        at = end - len(stream.unused_data)
        if struct.unpack_from("<II", content, at) != (MARK_MAGIC, 1):
            raise ValueError("a record isn't followed by its mark")
        at += 9
        yield b"".join(data)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record at ``path``. The digest of a
    response is computed from the payload read; a revisit has that of the payload it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[list] = [[], [], [], [], []]
                for data in read_records(content.as_buffer().to_pybytes()):
                    warc, http, payload = parse(data)
                    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError("a payload doesn't have its digest")
                    page, refers = warc["X-Page-ID"], warc.get("X-Refers-To-Page-ID")
                    for column, value in zip(out, (int(page) if page else None, int(http["Content-Length"]), digest, kind, None if refers is None else int(refers)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write one record for each row of ``pages`` (``page_id, url, html``; other columns are ignored) to archives of
    about ``file_bytes`` payload bytes; returns the folder. Null html is empty. Of equal payloads of ``min_bytes`` or more the
    smallest page id is the response; rows that repeat that id are responses too. Rows without an id revisit like
    others; their group's response is the smallest id, and groups without any id are all responses. Payloads of any
    length are stored whole. An empty table gives a folder without records."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes, file_bytes)
    return path


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
