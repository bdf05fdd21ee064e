"""Best-fit packing of tokenised documents by minimum bin slack.

A document's ids (with the end id) are one piece if they fit a sequence; a longer document is cut into full pieces of
``capacity`` ids behind a first piece that holds the rest. What a packing needs to know of the corpus is how many
pieces there are of each length, which is at most ``capacity`` numbers at any corpus size. Minimum bin slack runs on that
histogram: for one bin, the longest length left is placed and a bitset subset-sum dynamic program over the available
lengths finds the fullest feasible complement. As long as the lengths chosen are still available the next bin would
get the same answer, so the combination is taken as often as the counts allow at once. The number of combinations is
bounded by the capacity (a length limits a combination less than capacity / length times), not by the corpus.

Pieces then take the slots of their length in turn. The turn of a piece is its rank within its length, from windows
over hashed buckets of each length plus the sizes of the buckets before. A length has at most ``BUCKETS`` buckets, so no
window over sizes holds more rows than that, and no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import CHUNK_BYTES, free_name, map_batches, materialize, quoted, slices
from ._tokens import memo

#: Pieces that share a window when pieces are ranked, as long as a length has no more than ``BUCKETS`` windows.
BUCKET_ROWS, BUCKETS = 256, 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(room: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``; ``available`` is (length, count), in the order of
    preference. Counts are split into powers of two, and bit k of a stage's bitset says that sum k can be reached."""
    stages, reach, full = [], 1, (1 << (room + 1)) - 1
    for length, count in available:
        left = min(count, room // length)
        step = 1
        while left > 0:
            take = min(step, left)
            before, reach = reach, (reach | reach << (take * length)) & full
            if reach != before:
                stages.append((length, take, before))
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, {length: pieces in each bin}) for a histogram of piece lengths, lengths in descending order."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        seed = lengths[0]
        rest = [(n, left[n] - (n == seed)) for n in lengths if n <= capacity - seed]
        chosen = fullest(capacity - seed, [x for x in rest if x[1]])
        chosen[seed] = chosen.get(seed, 0) + 1
        bins = min(left[n] // k for n, k in chosen.items())
        out.append((bins, dict(sorted(chosen.items(), reverse=True))))
        for n, k in chosen.items():
            left[n] -= bins * k
        lengths = [n for n in lengths if left[n]]
    return out


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """``PIECES`` of every document. Null and empty texts give one piece that holds the end id alone. Repeated rows
    and null ids are kept as they are; other columns are ignored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 2 * CHUNK_BYTES):
                ids, bounds = encoder.encode(part.column("text"), end_id)
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                head = total - (pieces - 1) * capacity
                doc = np.repeat(np.arange(len(total)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
                length = np.where(number == 0, head[doc], capacity)
                raw, at = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B"), (bounds[doc] + start) * 4
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES)


def slots(patterns: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """One row for each length of each pattern: the ranks [low, high) that it serves and where they lie."""
    rows, used, base = [], {}, 0
    for bins, chosen in patterns:
        offset = 0
        for length, k in chosen.items():
            low = used.get(length, 0)
            used[length] = low + bins * k
            rows.append((length, low, used[length], k, base, offset))
            offset += length * k
        base += bins
    return pd.DataFrame(rows, columns=["length", "low", "high", "k", "base", "offset"], dtype=np.int64).sort_values(["length", "low"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = 1024, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``doc_id, piece, length`` (1 <= length <= capacity, or a
    ValueError). The input must be stable (a table), as it is read twice. Each row takes part once, rows that repeat ids and
    rows with null ids too; an empty input gives no rows. Other columns stay as they are, whatever their names, but
    columns named ``sequence_id`` or ``offset`` give way to the new ones."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"a piece must have 1 to {capacity} ids")
    table = slots(plan(histogram, capacity))
    buckets, bucket, before, rank, place_ = (free_name(pieces, f"__{n}") for n in ("buckets", "bucket", "before", "rank", "place"))
    small = spark.createDataFrame([(int(k), min(BUCKETS, -(-int(n) // bucket_rows))) for k, n in histogram.items()] or [(0, 1)], f"length long, {buckets} long")
    placed = pieces.join(F.broadcast(small), "length").withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece"), F.col(buckets)))  # a row a length
    key = ["length", bucket]
    sizes = placed.groupBy(*key).agg(F.count("*").alias(before))
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece")) - 1
    ranked = placed.withColumn(rank, turn).join(sizes, key).withColumn(rank, F.col(rank) + F.col(before))
    lengths, lows = table["length"].to_numpy(), table["low"].to_numpy()
    _, ks, bases, offsets = (table[c].to_numpy() for c in ("high", "k", "base", "offset"))
    span = int(lows.max(initial=0)) + 1 + max([0, *histogram.values()])
    edges = lengths * span + lows  # ascending

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        at = np.searchsorted(edges, n * span + r, side="right") - 1
        j = r - lows[at]
        return pd.DataFrame({"sequence_id": bases[at] + j // ks[at], "offset": offsets[at] + j % ks[at] * n})

    out = ranked.withColumn(place_, place("length", rank))
    kept = quoted([c for c in pieces.columns if c not in ("sequence_id", "offset")])
    return out.select(*kept, F.col(f"{place_}.sequence_id").alias("sequence_id"), F.col(f"{place_}.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack all documents (``doc_id``, ``text``; other columns are ignored) into sequences of at most ``capacity``
    ids. Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row for each piece. Null and empty
    texts are the end id alone, a text of any length is taken whole, repeated rows and null ids are packed like others, an
    empty table gives no rows."""
    return pack(materialize(tokenized_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


