"""Token-id files: canonical length-limited Huffman codes of ids, in independent blocks with bit-offset checkpoints.

File layout (all integers little-endian). One file for each task, documents in ascending ``doc_id`` over the files::

    header   b"TSRAHUF1", u32 alphabet size, u8 code length of each id (0: id doesn't occur)
    chunk*   u32 documents, u32 blocks, u64 ids, u64 payload bytes, then
             i64 doc_id and u64 ids of each document, u64 first bit of each block (the checkpoints),
             payload bits, most significant first, padded to bytes with at least 8 zero bytes,
             b"\\n"

A block holds ``BLOCK`` consecutive ids of the chunk (the last one fewer). The canonical code follows from the lengths
alone: codes ascend by (length, id). Lengths come from the package-merge algorithm over global counts, at most
``MAX_BITS``. Decoding looks up ``MAX_BITS`` bits in a table for id and length; blocks are independent, so all blocks of
a chunk advance together, one id at a step. Bits are written by Spark's own writer (each chunk is one "line" whose line
feed belongs to the format), hence through Hadoop's file systems, with their commit protocol for retried tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import CHUNK_BYTES, map_batches, materialize, scratch_path, slices
from ._tokens import memo

MAGIC = b"TSRAHUF1"
MAX_BITS = 18
BLOCK = 256
#: Files whose starts are summed up in one window.
FILE_RUN = 4096
#: Ids in a chunk at least, unless the file ends.
CHUNK_IDS = 1 << 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; zero for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("the alphabet doesn't fit the length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weight, n = counts[order].astype(np.float64), len(order)
    levels = []  # of each level: is the merged item a package
    packages = np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([weight, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by >= n)
        merged = merged[by]
        pairs = len(merged) // 2
        packages = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    take, length = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for package in reversed(levels):  # the first `take` items of a level: leaves are a prefix of the sorted ids
        chosen = package[:take]
        leaves = int((~chosen).sum())
        length[:leaves] += 1
        take = 2 * int(chosen.sum())
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, right-aligned."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    for bits in np.unique(lengths[order]):
        group = order[lengths[order] == bits]
        code <<= int(bits) - last
        codes[group] = code + np.arange(len(group))
        code, last = code + len(group), int(bits)
    return codes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Payload and the first bit of each block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 3, dtype=np.uint64)
    if len(ids):
        slot = at >> 5
        wide = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)  # the code within 64 bits from its 32-bit word on
        runs = np.flatnonzero(np.diff(slot, prepend=-1))
        place = slot[runs]
        words[place] |= np.bitwise_or.reduceat(wide >> np.uint64(32), runs)
        words[place + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), runs)
    return words.astype(">u4").tobytes()[: (total + 7) // 8] + bytes(8), at[::block].astype(np.uint64)


class Decoder:
    """Table-driven decoding with a table of 2 ** max_bits entries."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        self.id = np.zeros(1 << self.bits, dtype=np.uint32)
        self.size = np.zeros(1 << self.bits, dtype=np.int64)
        codes = canonical(lengths)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = 1 << (self.bits - lengths[order].astype(np.int64))
        total = int(width.sum())
        self.id[:total] = np.repeat(order, width)
        self.size[:total] = np.repeat(lengths[order].astype(np.int64), width)
        assert not len(order) or int(codes[order[0]]) == 0

    def decode(self, payload: bytes, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        data = np.frombuffer(payload, dtype=np.uint8)
        words = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data.data, strides=(1,))
        out = np.zeros((len(starts), block), dtype=np.uint32)
        at = starts.astype(np.int64)
        lanes = len(starts)
        tail = n - (lanes - 1) * block if lanes else 0
        mask = np.uint64((1 << self.bits) - 1)
        for step in range(min(block, n)):
            if step == tail and lanes > 1:
                lanes -= 1
                at = at[:lanes]
            window = words[at >> 3].astype(np.uint64) >> (64 - self.bits - (at & 7)).astype(np.uint64)
            entry = window & mask
            out[:lanes, step] = self.id[entry]
            at = at + self.size[entry]
        return out.reshape(-1)[:n]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows ``doc_id, n, ids`` (packed little-endian ids), and rows ``counts`` (u64 of each id) once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo(tokenizer)
        counts = np.zeros(encoder.encoder.get_vocab_size(), dtype="<u8")
        for batch in batches:
            for part in slices(batch, "text", 2 * CHUNK_BYTES):
                ids, bounds = encoder.encode(part.column("text"), end_id)
                counts += np.bincount(ids, minlength=len(counts)).astype("<u8")
                width = ids.dtype.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), packed.cast(pa.binary()), pa.nulls(len(bounds) - 1, pa.binary())], ["doc_id", "n", "ids", "counts"])
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "n", "ids", "counts"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, ids binary, counts binary")


def global_counts(table: DataFrame) -> np.ndarray:
    """Sum of the ``counts`` rows, added up on the executors to one row for each id in use."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0).to_pylist():
                own = np.frombuffer(row, dtype="<u8")
                total = own.copy() if total is None else total + own
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used].astype(np.int64), pa.int64())], ["id", "n"])

    rows = table.where("counts is not null").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    out[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def write_files(table: DataFrame, lengths: np.ndarray, path: str, width: int, partitions: int) -> None:
    """Write the ``doc_id, n, ids`` rows of ``table`` to files in ascending order of ``doc_id`` (nulls first)."""
    codes, dtype = canonical(lengths), f"<u{width}"
    header = MAGIC + struct.pack("<I", len(lengths)) + lengths.tobytes()

    def chunk(doc_ids: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
        payload, starts = encode_bits(ids, codes, lengths)
        return struct.pack("<IIQQ", len(doc_ids), len(starts), len(ids), len(payload)) + np.array(doc_ids, dtype="<i8").tobytes() + np.array(sizes, dtype="<u8").tobytes() + starts.astype("<u8").tobytes() + payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, doc_ids, sizes, parts, held = header, [], [], [], 0
        for batch in batches:
            for doc, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids.append(NULL_ID if doc is None else doc)
                sizes.append(n)
                parts.append(np.frombuffer(ids.as_buffer(), dtype=dtype))
                held += n
                if held >= CHUNK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([lead + chunk(doc_ids, sizes, np.concatenate(parts))], pa.binary())], ["value"])
                    lead, doc_ids, sizes, parts, held = b"", [], [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([lead + chunk(doc_ids, sizes, np.concatenate(parts))], pa.binary())], ["value"])

    # Rows of one id may be many: the hash lets them spread over partitions, in one order.
    order = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.xxhash64("ids")]
    rows = table.where("ids is not null").select("doc_id", "n", "ids").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    map_batches(rows, run, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)


#: Stands for a null id in the files.
NULL_ID = -(1 << 63)


def read_file(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, ids of each document, ids) of each chunk of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token-id file")
    (size,) = struct.unpack_from("<I", content, 8)
    decoder = Decoder(np.frombuffer(content, dtype=np.uint8, count=size, offset=12))
    at, view = 12 + size, memoryview(content)
    while at < len(content):
        docs, blocks, n, payload = struct.unpack_from("<IIQQ", content, at)
        at += 24
        doc_ids = np.frombuffer(content, dtype="<i8", count=docs, offset=at)
        sizes = np.frombuffer(content, dtype="<u8", count=docs, offset=at + 8 * docs).astype(np.int64)
        starts = np.frombuffer(content, dtype="<u8", count=blocks, offset=at + 16 * docs)
        at += 16 * docs + 8 * blocks
        yield doc_ids, sizes, decoder.decode(view[at : at + payload], starts, n)
        at += payload
        if content[at : at + 1] != b"\n":
            raise ValueError("a chunk doesn't end with its mark")
        at += 1


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files at ``path``,
    which ``write_files`` wrote. Null ids come back as nulls; a folder without documents gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = 0
                for doc_ids, sizes, ids in read_file(content.as_buffer().to_pybytes()):
                    raw, ends = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B"), np.cumsum(sizes)
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(sizes)), pa.array(np.where(doc_ids == NULL_ID, 0, doc_ids), pa.int64(), mask=doc_ids == NULL_ID), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = materialize(rows, "token-digest")
    return rows.join(file_starts(rows), "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def file_starts(rows: DataFrame, run: int = FILE_RUN) -> DataFrame:
    """``file, base``: the ids before each file, from rows ``file, n_tokens``. Files ascend by the part number in their
    names. Sums run over runs of ``run`` files, and over the runs' totals."""
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", "n", number.alias("k"), F.floor(number / run).alias("run"))
    inside = Window.partitionBy("run").orderBy("k", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run of files
    runs = totals.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = totals.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(runs, "run").select("file", (F.col("first") + F.col("own")).alias("base"))


def encode_corpus(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, file_bytes: int = 8 << 20) -> tuple[str, np.ndarray]:
    """Encode every document into token-id files of about ``file_bytes`` of ids before coding; returns the folder and
    the code lengths. Null texts count as empty (the end id alone), null ids sort first, repeated rows are written
    repeatedly, rows of one id come in the order of their numbers of ids, texts of any length are written whole, other columns are ignored; an empty input gives a folder without documents."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    table = materialize(tokenize(docs, tokenizer, end_id), "token-ids")
    counts = global_counts(table)
    width = memo(tokenizer).dtype().itemsize
    lengths = code_lengths(counts)
    write_files(table, lengths, path, width, max(1, -(-int(counts.sum()) * width // file_bytes)))
    return path, lengths
