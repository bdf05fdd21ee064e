"""SimHash near-duplicates by tiled exact comparison.

Fingerprints (64 bits of word shingles) are linked if at most ``RADIUS`` bits differ. All pairs of distinct
fingerprints are accounted for: they are sorted by population counts and cut into tiles; two tiles are compared in full,
by numpy exclusive-or and bit counts, unless their population counts differ beyond the radius. The counts are taken of
each of the eight bytes of a fingerprint: the sum of the differences of those counts can't exceed the number of
differing bits, so a tile pair whose count ranges are further apart holds no link.

Distribution. Distinct fingerprints (copies share one) are dealt into cells by the population counts of their two
halves, and big cells into chunks of at most about ``CHUNK`` fingerprints. A task's unit is a pair of chunks of cells
within the radius: two packed rows of at most a few hundred kilobytes, joined by the unit's number; units are dealt to
tasks by the comparisons they make, not by bytes. Each unit gives the edges of a spanning forest of its links, fewer than
it has fingerprints, so a group of near copies never becomes a list of all its pairs. Forests are merged by alternating
large-star and small-star contractions until nothing changes. Joins on a fingerprint, a hub or a component deal the rows
of hot keys over many tasks (``skew_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, map_batches, materialize, release, skew_join, slices, text_buffer

RADIUS = 3
WORDS = 3
CHUNK = 16_384
TILE = 128
#: Comparisons that a task of units is meant to make.
TASK_WORK = 1 << 31

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of byte ranges of a buffer that is padded by 8 bytes or more. Ranges of one length are hashed together."""
    out = np.empty(len(start), dtype=np.uint64)
    eight = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data.data, strides=(1,))
    four = np.ndarray(shape=(max(len(data) - 3, 0),), dtype="<u4", buffer=data.data, strides=(1,))
    seed = np.uint64(seed)
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 1 << 16 else size, kind="stable")
    lengths, firsts = np.unique(size[order], return_index=True)
    with np.errstate(over="ignore"):
        for length, a, b in zip(lengths.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(order)], strict=True):
            rows = order[a:b]
            at = start[rows].astype(np.int64)
            done = 0
            if length >= 32:
                acc = [np.full(len(rows), x, dtype=np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while length - done >= 32:
                    for k in range(4):
                        acc[k] = _round(acc[k], eight[at + (done + 8 * k)])
                    done += 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for x in acc:
                    h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
            else:
                h = np.full(len(rows), seed + _P5, dtype=np.uint64)
            h += np.uint64(length)
            while length - done >= 8:
                h = _rotl(h ^ _round(np.zeros_like(h), eight[at + done]), 27) * _P1 + _P4
                done += 8
            if length - done >= 4:
                h = _rotl(h ^ (four[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < length:
                h = _rotl(h ^ (data[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
#: Byte value -> its eight bits as the eight bytes of a word, most significant bit first.
_spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, for each run [bounds[i], bounds[i + 1]), runs not empty. Shape (runs, 64),
    most significant bit first. Bits are summed as bytes, eight to a word, over at most 255 hashes at once."""
    first, n = bounds[:-1], np.diff(bounds)
    parts = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), parts)
    begin = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    octets = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    sums = np.empty((len(owner), 8), dtype=np.uint64)
    for k in range(8):
        sums[:, k] = np.add.reduceat(_spread[octets[:, k]], begin)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)


def shingle_hashes(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of whole texts, and how many each text has. A-Z are lower-cased; shingles are runs of
    ``words`` words, joined by spaces, repeats included; a text with fewer words is one shingle; one without words has
    none."""
    raw, offsets = text_buffer(column)
    data = _lower[raw[: offsets[-1]]]
    space = _space[data]
    # Normalised buffer: each word followed by one space. Shingles are byte ranges of it.
    solid = ~space
    ends = np.zeros(len(data), dtype=bool)  # last byte of a word
    if len(data):
        ends[:-1] = solid[:-1] & space[1:]
        ends[-1] = solid[-1]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] = solid[last]
    width = solid.astype(np.int64) + ends
    place = np.cumsum(width) - width
    text = np.full(int(width.sum()) + 40, 0x20, dtype=np.uint8)
    text[place[solid]] = data[solid]
    stop = place[ends] + 1  # one past each word
    per_doc = np.diff(np.concatenate([[0], np.cumsum(ends, dtype=np.int64)])[offsets])
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    shingles = np.where(per_doc >= words, per_doc - words + 1, np.minimum(per_doc, 1))
    doc_first = np.cumsum(per_doc) - per_doc
    bounds = np.cumsum(shingles) - shingles
    of = np.repeat(np.arange(len(per_doc)), shingles)
    head = doc_first[of] + np.arange(len(of)) - bounds[of]
    tail = head + np.minimum(per_doc[of], words) - 1
    return xxh64(text, begin[head], stop[tail] - begin[head]) if len(of) else np.zeros(0, dtype=np.uint64), shingles


def majorities(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of ``shingles`` hashes: the bits that more than half of a run's hashes have. Zero for none."""
    out = np.zeros(len(shingles), dtype=np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        counts = bit_counts(hashes, np.concatenate([[0], np.cumsum(shingles[full])]))
        bits = 2 * counts > shingles[full][:, None]
        out[full] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """64-bit fingerprints of whole texts, over ``shingle_hashes``."""
    return majorities(*shingle_hashes(column, words))


def with_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fingerprints(part.column("text"), words).view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def byte_counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the eight bytes, shape (n, 8)."""
    return np.bitwise_count(np.ascontiguousarray(fp.astype(">u8")).view(np.uint8).reshape(-1, 8)).astype(np.int8)


def _tiles(fp: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in the order of their byte counts, and of each tile its start and its least and greatest counts."""
    pop = byte_counts(fp)
    order = np.lexsort(pop.T[::-1])
    fp, pop = fp[order], pop[order]
    start = np.arange(0, len(fp), tile)
    return fp, start, np.minimum.reduceat(pop, start), np.maximum.reduceat(pop, start)


class Forest:
    """Union-find over the positions of sorted fingerprints, keeping the edges that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def linked(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between distinct fingerprints of two chunks, or of one chunk."""
    fp_a, start_a, low_a, high_a = _tiles(left, tile)
    same = right is None
    fp_b, start_b, low_b, high_b = (fp_a, start_a, low_a, high_a) if same else _tiles(right, tile)
    nodes = fp_a if same else np.concatenate([fp_a, fp_b])
    shift = 0 if same else len(fp_a)
    forest = Forest(len(nodes))
    for i in range(len(start_a)):
        first = i if same else 0
        gap = np.maximum(low_a[i] - high_b[first:], low_b[first:] - high_a[i]).clip(min=0).sum(axis=1)
        near = first + np.flatnonzero(gap <= radius)
        if not len(near):
            continue
        a = fp_a[start_a[i] : start_a[i] + tile]
        for group in np.array_split(near, -(-len(near) // 64)):
            at = (start_b[group][:, None] + np.arange(tile)).ravel()
            at = at[at < len(fp_b)]
            hit = np.flatnonzero(np.bitwise_count(a[:, None] ^ fp_b[at][None, :]) <= radius)
            x, y = start_a[i] + hit // len(at), shift + at[hit % len(at)]
            if same:
                ordered = x < y
                x, y = x[ordered], y[ordered]
            forest.union(x, y)
    everyone = np.arange(len(nodes))
    root = forest.roots(everyone)
    child = np.flatnonzero(root != everyone)
    return nodes[child].view(np.int64), nodes[root[child]].view(np.int64)


def link_edges(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: edges of spanning forests, one of each unit, over the links between the distinct values of ``fp``.
    The input must be stable (a table), as it is read twice."""
    spark = fps.sparkSession
    half = F.bit_count(F.shiftrightunsigned("fp", 32)) * 64 + F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    celled = fps.select("fp", half.cast("int").alias("cell"))
    counts = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # 33 * 33 cells at most
    chunks = {c: -(-n // chunk) for c, n in counts.items()}
    # Units (cell, chunk) x (cell, chunk) are numbered by the two global chunk numbers.
    base, total = {}, 0
    for c in sorted(chunks):
        base[c], total = total, total + chunks[c]
    near = [(c, base[c], n, [d for d in sorted(chunks) if abs(c // 64 - d // 64) + abs(c % 64 - d % 64) <= radius]) for c, n in chunks.items()]
    frame = spark.createDataFrame(
        [(c, b, n, [(base[d], base[d] + chunks[d] - 1) for d in ds]) for c, b, n, ds in near] or [(0, 0, 1, [])],
        "cell int, base long, chunks long, near array<struct<first: long, last: long>>",
    )
    own = F.col("base") + F.pmod(F.xxhash64("fp"), F.col("chunks"))
    packed = celled.join(F.broadcast(frame), "cell").select(own.alias("chunk"), "fp", "near").groupBy("chunk").agg(F.collect_list("fp").alias("fps"), F.first("near").alias("near"))
    packed = materialize(packed, "simhash-chunks")
    other = F.explode(F.flatten(F.transform("near", lambda s: F.sequence(s["first"], s["last"]))))
    pairs = packed.select("chunk", "fps", other.alias("other"))
    unit = lambda x, y: (F.col(x) * F.lit(total) + F.col(y)).alias("unit")
    left = pairs.where("chunk <= other").select(unit("chunk", "other"), F.col("fps").alias("left"), (F.col("chunk") == F.col("other")).alias("same"))
    right = pairs.where("chunk > other").select(unit("other", "chunk"), F.col("fps").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(i)[k].values for i in (1, 3))
                x, y = linked(a.to_numpy().view(np.uint64), None if b is None else b.to_numpy().view(np.uint64), radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    work = sum(min(counts[c], chunk * chunks[c]) * counts[d] for c, _, _, ds in near for d in ds) // 2
    tasks = unit_tasks(spark, sum(chunks[c] * chunks[d] for c, _, _, ds in near for d in ds), work)
    units = left.repartition(tasks, "unit").join(right.repartition(tasks, "unit"), "unit", "left")
    return map_batches(units.select("unit", "left", "same", "right"), run, "a long, b long")


def unit_tasks(spark: SparkSession, units: int, work: int) -> int:
    """Tasks for a number of units that make ``work`` comparisons together."""
    return max(1, min(units, max(2 * spark.sparkContext.defaultParallelism, -(-work // TASK_WORK))))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes that occur in edges ``a, b``, by large-star and small-star steps until no edge
    changes. Each step keeps at most one edge for each edge it has and is written to the shared folder, in place of the
    step before. A hub's edges meet its least neighbour in many tasks."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
        return skew_join(rows, least, "u", "n", total, ["v"], "inner")

    last = state(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = star(both.where("v > u"), least, 2 * last[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "cc")
        release(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = star(large, least, last[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u <> v").distinct(), "cc")
        release(large)
        now = state(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def simhash(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs`` (``doc_id, text``; other columns are ignored).
    ``component_id`` is the smallest id reachable over links. Null and empty texts have fingerprint zero and link like
    any other. Null ids are no candidates for ``component_id`` (null if a component has no other). Repeated rows are
    returned repeatedly, texts of any length count whole, and a bit that exactly half of the shingles have is 0. An empty
    table gives no rows."""
    rows = materialize(with_fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = materialize(components(link_edges(distinct.select("fp"), radius, chunk)), "components")
    member = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "root", "least")
    # Components may hold many fingerprints, and fingerprints many rows.
    named = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    told = skew_join(member, named, "root", "many", n, ["fp"], "inner").select("fp", "component_id")
    known = distinct.join(told, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return skew_join(rows, known, "fp", "n", total, ["doc_id"], "inner").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` that are first in their component, with their columns, whatever other columns are called. Rows
    without an id stay, and so do all rows of an id that is first. Null and empty texts are copies of each other, texts of
    any length count whole, an empty table gives no rows."""
    name = free_name(docs, "__first_id")
    first = simhash(docs, words, radius).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(first, docs["doc_id"].cast("long") == F.col(name), "left_semi").unionByName(docs.where("doc_id is null"))
