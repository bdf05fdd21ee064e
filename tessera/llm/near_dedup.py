"""Near-duplicate stage of the corpus pipeline: SimHash candidates of five-word shingles, checked exactly.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8 (of the shingles'
64-bit hashes, to be exact) and their fingerprints are within the radius. Fingerprints are over the distinct shingles and
have 128 bits, of which ``RADIUS`` may differ and ``FIRST`` of the first 64: wide enough for that similarity, narrow
enough that few unrelated pairs have to be checked.

All pairs of distinct sets are accounted for by tiled exact comparison of fingerprints, with tile pairs skipped whose
population counts differ beyond the radius. Sets whose sizes differ by more than a fourth can't be similar enough, so
documents are dealt into cells by size, cells into chunks, and a unit is a pair of chunks of cells within that ratio. A
unit has blocks, pairs of runs of rows of either chunk that hold a bounded number of hashes. Fingerprints alone tell which
rows have a candidate in a block; then, block by block, the whole sets of those rows are brought together and each candidate
is checked, unless links found before put both sides together already. What leaves a block are the links of a spanning
forest. So no list of pairs is ever written, whether a group's members are similar enough or just not. First of all, every set is compared with the leader of
those that share a least hash with it, which puts large groups of near copies together in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, map_batches, materialize, skew_join, slices
from .simhash import CHUNK, Forest, components, majorities, shingle_hashes, unit_tasks

WORDS = 5
#: Differing bits of the first 64, and of all 128.
FIRST, RADIUS = 20, 36
#: Least hashes of a set under as many orders.
LEAST = 4
#: Rows of a tile, and of what it is compared with at once.
TILE, SPAN = 128, 8192
#: Rows of a block's side at most, and hashes of their sets (or one set). A chunk has up to BLOCKS blocks' sides.
BLOCK, BLOCK_HASHES, BLOCKS = 1024, 1 << 21, 16
#: More than the sides of blocks of any chunk.
BLOCK_NUMBERS = 1 << 12
#: Cells of sizes: each a quarter of the way to the greatest ratio of similar sets, 5 / 4.
STEPS = 4

_masks = np.random.default_rng(42).integers(0, 1 << 63, LEAST, dtype=np.uint64)
_PRINT = "a long, b long, n int, total long, " + ", ".join(f"m{j} long" for j in range(LEAST))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of whole texts, ascending in each text, and how many each text has."""
    hashes, n = shingle_hashes(column, words)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.bincount(of[new], minlength=len(n))


def prints(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Columns of ``_PRINT`` for sets: the two halves of the fingerprint, size, sum of mixed hashes, least hashes."""
    mixed = _mixed(hashes)
    full = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[full]
    out = [majorities(hashes, n), majorities(mixed, n), n.astype(np.int32)]
    for j in range(-1, LEAST):
        column = np.zeros(len(n), dtype=np.uint64)
        if len(full):
            column[full] = np.add.reduceat(_mixed(mixed), first) if j < 0 else np.minimum.reduceat(hashes ^ _masks[j], first)
        out.append(column)
    return [x if x.dtype == np.int32 else x.view(np.int64) for x in out]


def with_prints(docs: DataFrame, sets: bool) -> DataFrame:
    """``doc_id``, the set's ``key`` and fingerprint columns of each row; with ``sets`` the hashes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, n = shingle_sets(part.column("text"))
                columns = [part.column("doc_id"), *map(pa.array, prints(hashes, n))]
                if sets:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(hashes.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id long, {_PRINT}" + (", hashes array<long>" if sets else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return map_batches(docs.select("doc_id", "text"), run, schema).withColumn("key", F.xxhash64("a", "b", "n", "total"))


class Side(NamedTuple):
    """Rows of a chunk, in the order of the population counts of ``a``."""

    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    root: np.ndarray
    pop: np.ndarray
    order: np.ndarray  # places of the rows before they were sorted


def side(key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, root: np.ndarray) -> Side:
    a, b = a.view(np.uint64), b.view(np.uint64)
    pop = np.bitwise_count(a).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    return Side(key[order], a[order], b[order], n[order].astype(np.int64), root[order], pop[order], order)


def candidates(one: Side, two: Side | None, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``one``, in ``two``) of pairs within the radius and the ratio of sizes and not together yet, of two chunks
    or of one."""
    other = one if two is None else two
    for start in range(0, len(one.key), tile):
        stop = start + tile
        low, high = np.searchsorted(other.pop, one.pop[start] - FIRST, "left"), np.searchsorted(other.pop, one.pop[start:stop][-1] + FIRST, "right")
        for at in range(start if two is None else low, high, SPAN):
            end = min(at + SPAN, high)
            hit = np.flatnonzero(np.bitwise_count(one.a[start:stop, None] ^ other.a[at:end]) <= FIRST)
            x, y = start + hit // (end - at), at + hit % (end - at)
            near = np.bitwise_count(one.a[x] ^ other.a[y]) + np.bitwise_count(one.b[x] ^ other.b[y]) <= RADIUS
            x, y = x[near], y[near]
            nx, ny = one.n[x], other.n[y]
            good = (one.root[x] != other.root[y]) & (5 * np.minimum(nx, ny) >= 4 * np.maximum(nx, ny))
            if two is None:
                good &= x < y
            if good.any():
                yield x[good], y[good]


def checked(one: Side, two: Side | None, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of links that join what wasn't together: candidates whose sets have a Jaccard similarity of 0.8 or more.
    ``sets`` holds those of ``one``'s rows and then of ``two``'s."""
    shift = 0 if two is None else len(one.key)
    keys, roots = (np.concatenate([x, y]) if two is not None else x for x, y in ((one.key, two and two.key), (one.root, two and two.root)))
    size = np.array([len(x) for x in sets], dtype=np.int64)
    first = np.cumsum(size) - size
    _, code = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (None, np.zeros(0, np.int64))
    mark = np.zeros(int(code.max(initial=0)) + 1, dtype=bool)
    forest = Forest(len(keys))
    by = np.argsort(roots, kind="stable")
    alike = np.flatnonzero(roots[by][1:] == roots[by][:-1])
    forest.union(by[alike], by[alike + 1])
    found: list[tuple[int, int]] = []
    for x, y in candidates(one, two):
        y = y + shift
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        bounds = np.flatnonzero(np.diff(x, prepend=-1))
        for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(x)], strict=True):
            me = int(x[i])
            mine = code[first[me] : first[me] + size[me]]
            mark[mine] = True
            for k in range(i, j, 256):
                others = y[k : min(k + 256, j)]
                others = others[forest.roots(others) != forest.roots(np.array([me]))[0]]
                full = others[size[others] > 0]
                if not len(full):
                    continue
                ends = np.cumsum(size[full])
                at = np.arange(int(ends[-1])) + np.repeat(first[full] - (ends - size[full]), size[full])
                both = np.add.reduceat(mark[code[at]], ends - size[full], dtype=np.int64)
                alike = full[9 * both >= 4 * (size[me] + size[full])]
                if len(alike):
                    _, new = np.unique(forest.roots(alike), return_index=True)
                    found += [(me, int(o)) for o in alike[new]]
                    forest.union(np.full(len(new), me), alike[new])
            mark[mine] = False
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return keys[pairs[:, 0]], keys[pairs[:, 1]]


def _numpy(cell: pa.Scalar) -> Side | None:
    return side(*(x.to_numpy() for x in cell.values.flatten())) if cell.is_valid else None


def blocks(unit: int, one: Side, two: Side | None, hashes: int = BLOCK_HASHES) -> Iterator[pa.RecordBatch]:
    """The rows of ``rows_in_units`` for a unit."""
    other = one if two is None else two
    width = max(1, min(BLOCK, hashes // max(1, int(max(one.n.max(), other.n.max())))))
    many, across = -(-len(one.key) // width), -(-len(other.key) // width)
    mine, theirs = np.zeros((len(one.key), across), dtype=bool), np.zeros((len(other.key), many), dtype=bool)
    for x, y in candidates(one, two):
        mine[x, y // width] = True
        theirs[y, x // width] = True

    def rows(s: Side, at: np.ndarray, i: int, j: int, right: bool) -> pa.RecordBatch:
        number = (unit * BLOCK_NUMBERS + i) * BLOCK_NUMBERS + j
        columns = [np.full(len(at), number), np.full(len(at), right), s.key[at], s.a[at].view(np.int64), s.b[at].view(np.int64), s.n[at].astype(np.int32), s.root[at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["unit", "right", "key", "a", "b", "n", "root"])

    for i in range(many):
        for j in range(i if two is None else 0, across):
            left = np.flatnonzero(mine[i * width : (i + 1) * width, j])
            right = np.flatnonzero(theirs[j * width : (j + 1) * width, i])
            if not len(left):
                continue
            if two is None and i == j:
                yield rows(one, i * width + np.union1d(left, right), i, j, False)
            else:
                yield rows(one, i * width + left, i, j, False)
                yield rows(other, j * width + right, i, j, True)


def rows_in_units(nodes: DataFrame, chunk: int = CHUNK, hashes: int = BLOCK_HASHES) -> DataFrame:
    """``unit, right, key, a, b, n, root``: rows of ``nodes`` (``key, a, b, n, root``, a table) that have a candidate in a
    block, on its left or right side; a run of rows with itself has a left side alone. ``unit`` numbers the blocks."""
    spark = nodes.sparkSession
    cell = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1.25)) * STEPS).cast("int")
    celled = nodes.withColumn("cell", cell)
    counts = {r["cell"]: (r["rows"], r["total"]) for r in celled.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).collect()}  # a few hundred
    chunks = {c: max(-(-rows // chunk), min(rows, -(-total // (BLOCKS * hashes)))) for c, (rows, total) in counts.items()}
    base, total = {}, 0
    for c in sorted(chunks):
        base[c], total = total, total + chunks[c]
    near = {c: [d for d in sorted(chunks) if abs(c - d) <= STEPS] for c in chunks}
    frame = spark.createDataFrame(
        [(c, base[c], chunks[c], [(base[d], base[d] + chunks[d] - 1) for d in near[c]]) for c in sorted(chunks)] or [(0, 0, 1, [])],
        "cell int, base long, chunks long, near array<struct<first: long, last: long>>",
    )
    own = F.col("base") + F.pmod(F.xxhash64("key"), F.col("chunks"))
    packed = celled.join(F.broadcast(frame), "cell").select(own.alias("chunk"), "near", F.struct("key", "a", "b", "n", "root").alias("row"))
    packed = packed.groupBy("chunk").agg(F.collect_list("row").alias("rows"), F.first("near").alias("near"))
    packed = materialize(packed, "near-chunks")
    pairs = packed.select("chunk", "rows", F.explode(F.flatten(F.transform("near", lambda s: F.sequence(s["first"], s["last"])))).alias("other"))
    unit = lambda x, y: (F.col(x) * F.lit(total) + F.col(y)).alias("unit")
    left = pairs.where("chunk <= other").select(unit("chunk", "other"), F.col("rows").alias("left"), (F.col("chunk") == F.col("other")).alias("same"))
    right = pairs.where("chunk > other").select(unit("other", "chunk"), F.col("rows").alias("right"))
    work = sum(counts[c][0] * counts[d][0] for c in near for d in near[c]) // 2
    tasks = unit_tasks(spark, sum(chunks[c] * chunks[d] for c in near for d in near[c]), work)
    units = left.repartition(tasks, "unit").join(right.repartition(tasks, "unit"), "unit", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from blocks(batch.column("unit")[k].as_py(), _numpy(batch.column("left")[k]), _numpy(batch.column("right")[k]), hashes)

    return map_batches(units.select("unit", "left", "right"), run, "unit long, right boolean, key long, a long, b long, n int, root long")


def set_table(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, hashes, many`` of the sets named by ``keys`` (``key, many``), written."""
    ids = materialize(nodes.select("key", F.col("least").alias("doc_id")).join(keys, "key"), "near-ids")
    # An id may have several texts: the key tells which is meant.
    texts = docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = with_prints(texts, True).join(ids, ["doc_id", "key"]).groupBy("key").agg(F.first("hashes").alias("hashes"), F.first("many").alias("many"))
    return materialize(sets, "near-sets")


def links_in_units(docs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: spanning links of the units that ``rows`` (``rows_in_units``'s, a table) tells of."""
    sets = set_table(docs, nodes, rows.groupBy("key").agg(F.count("*").alias("many")))
    units, n = rows.agg(F.count_distinct("unit"), F.count("*")).first()
    whole = rows.join(sets.drop("many"), "key").repartition(unit_tasks(docs.sparkSession, units, n * BLOCK), "unit").sortWithinPartitions("unit")

    def unit(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        sides, sets = [], []
        for right in (False, True):
            part = table.filter(pa.compute.equal(table["right"], right))
            own = side(*(part[c].to_numpy() for c in ("key", "a", "b", "n", "root")))
            column = part["hashes"].combine_chunks()
            sets += [np.asarray(column[int(k)].values) for k in own.order]
            sides.append(own if part.num_rows else None)
        a, b = checked(sides[0], sides[1], sets)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            number = batch.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and number[i] != current:
                    yield unit(held)
                    held = []
                if j > i:
                    current = number[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield unit(held)

    return map_batches(whole, run, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b``: the pairs ``x, y`` of keys (a table; ``x`` may be in very many) whose whole sets have a Jaccard similarity
    of 0.8 or more."""
    total = pairs.count()
    sets = set_table(docs, nodes, pairs.select(F.explode(F.array("x", "y")).alias("key")).groupBy("key").agg(F.count("*").alias("many")))
    one = sets.select(F.col("key").alias("x"), F.col("hashes").alias("sx"), "many")
    two = sets.select(F.col("key").alias("y"), F.col("hashes").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    found = skew_join(pairs.join(two, "y"), one, "x", "many", 2 * total, ["y"], "inner")
    return found.where(9 * both >= 4 * (F.size("sx") + F.size("sy"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def groups(docs: DataFrame, chunk: int = CHUNK, hashes: int = BLOCK_HASHES) -> tuple[DataFrame, DataFrame]:
    """Distinct shingle sets of ``docs`` (``doc_id`` not null, ``text``) as ``key, least`` (its smallest id), and ``node,
    root`` of the keys that are linked."""
    rows = with_prints(docs, False)
    own = ["a", "b", "n", *(f"m{j}" for j in range(LEAST))]
    nodes = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in own)), "near-nodes")
    n, leads = nodes.count(), None
    for j in range(LEAST):
        # Leaders are per least hash and size, to a ratio: others can't be similar enough. Every other time the
        # intervals of sizes begin in the middle of the others, so that no group is parted by all.
        size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1.25)) + F.lit(j % 2 / 2))
        own = nodes.select("key", "a", "b", "n", F.xxhash64(f"m{j}", size).alias("under"))
        lead = own.groupBy("under").agg(F.min(F.struct("key", "a", "b", "n")).alias("lead"), F.count("*").alias("many")).where("many > 1")
        near = skew_join(own, lead, "under", "many", n, ["key"], "inner").where("key <> lead.key and 5 * least(n, lead.n) >= 4 * greatest(n, lead.n)")
        first = F.bit_count(F.col("a").bitwiseXOR(F.col("lead.a")))
        near = near.where((first <= FIRST) & (first + F.bit_count(F.col("b").bitwiseXOR(F.col("lead.b"))) <= RADIUS)).select(F.col("lead.key").alias("x"), F.col("key").alias("y"))
        leads = near if leads is None else leads.unionByName(near)
    led = materialize(verified(docs, nodes, materialize(leads.distinct(), "near-leads")), "near-led")
    roots = components(led)
    placed = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "a", "b", "n", F.coalesce("root", "key").alias("root"))
    rows = materialize(rows_in_units(materialize(placed, "near-placed"), chunk, hashes), "near-rows")
    found = materialize(links_in_units(docs, nodes, rows), "near-found")
    return nodes.select("key", "least"), materialize(components(led.unionByName(found)), "near-components")


def keep_first(docs: DataFrame, chunk: int = CHUNK, hashes: int = BLOCK_HASHES) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their group of near copies, with their columns, whatever other columns
    are called. Rows without an id stay and link nothing; of an id with several texts all rows stay if it is the smallest
    of some group. Null and empty texts and others without words count as equal; a text of fewer than five words is one
    shingle; texts of any length count whole; repeated rows share a verdict; an empty table gives no rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    nodes, linked = groups(own, chunk, hashes)
    name = free_name(docs, "__first_id")
    first = nodes.join(linked, nodes["key"] == linked["node"], "left").groupBy(F.coalesce("root", "key").alias("group")).agg(F.min("least").alias(name)).select(name).distinct()
    return docs.join(first, docs["doc_id"].cast("long") == F.col(name), "left_semi").unionByName(docs.where("doc_id is null"))
