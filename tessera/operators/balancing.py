"""Nearest neighbours in blocks, oversampling by interpolation, and cleaning by neighbours' votes.

Rows are ``id, label, features``. Neighbours are exact: rows are packed into blocks, a block of queries passes by the blocks of
candidates and keeps the k nearest of each query. Ties go to the smaller id, with squared distances rounded to nine digits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import defaults
from ..defaults import record
from ..functions.neighbours import Block, Nearest
from .sampling import SEED, class_counts, ranked

#: Rows of a block at most, and numbers in it; blocks that a task holds of the candidates; tasks a core.
BLOCK, CELLS, HELD, TASKS = 8192, 1 << 19, 16, 3
STRATEGIES = ("paper_balanced_subset", "none", "smote", "smoteenn")

Balancing = record("Balancing", defaults.BALANCING, "How training rows are balanced, and the neighbours that takes.")


def _packed(df: DataFrame, rows: int, parts: int, same_label: bool) -> DataFrame:
    """``num, low, high, ids, labels, xs``: blocks of at most ``rows`` rows, of labels that follow each other or of any."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    order = ["label", "id"] if same_label else ["id"]
    dealt = (df.repartitionByRange(parts, *order) if same_label else df.repartition(parts)).sortWithinPartitions(*order)

    def pack(held: list[pa.RecordBatch], num: int) -> pa.RecordBatch:
        ids, labels, xs = (pa.concat_arrays([b.column(name) for b in held]) for name in ("id", "label", "features"))
        sizes = pc.unique(pc.list_value_length(xs))
        if len(sizes) != 1 or sizes.null_count:
            raise ValueError("features must have one length in all rows")
        flat = xs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = pa.array([0, len(ids)], pa.int32())
        low, high = labels.slice(0, 1), labels.slice(len(labels) - 1)
        return pa.RecordBatch.from_arrays([pa.array([num], pa.int64()), low, high, pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, labels), pa.array([flat.tobytes()], pa.binary())], ["num", "low", "high", "ids", "labels", "xs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, num = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, rows - n))
                n, batch = n + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if n == rows:
                    yield pack(held, num)
                    held, n, num = [], 0, num + 1
        if held:
            yield pack(held, num)

    return dealt.mapInArrow(run, f"num long, low {kind['label']}, high {kind['label']}, ids array<{kind['id']}>, labels array<{kind['label']}>, xs binary")


def nearest(df: DataFrame, k: int, same_label: bool = True, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """``id, nn_id, nn_label, d2, rank`` of the ``k`` nearest other rows, of the same label or of all, for each row or for
    those of ``queries`` only."""
    df = df.select("id", "label", "features")
    queries = df if queries is None else queries.select("id", "label", "features")
    if same_label:
        df, queries = (x.where(F.col("label").isNotNull()) for x in (df, queries))
    size = df.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("dim")).first()
    rows = max(1, min(block, CELLS // max(1, size["dim"] or 1)))
    blocks = max(1, -(-size["n"] // rows))
    asking = max(blocks, min(-(-size["n"] // 512), TASKS * df.sparkSession.sparkContext.defaultParallelism))
    left = _packed(queries, rows, asking, same_label)
    # Written once as a shuffle and read by each task; the left side is made again for each partition of it.
    right = _packed(df, rows, blocks, same_label).repartition(-(-blocks // HELD)).toDF("b_num", "b_low", "b_high", "b_ids", "b_labels", "b_xs")
    overlap = (F.col("low") <= F.col("b_high")) & (F.col("b_low") <= F.col("high")) if same_label else None
    pairs = left.hint("shuffle_replicate_nl").join(right, overlap) if same_label else left.hint("shuffle_replicate_nl").crossJoin(right)

    def block_of(batch: pa.RecordBatch, row: int, side: str) -> Block:
        ids, labels = (batch.column(side + name)[row].values.to_numpy(zero_copy_only=False) for name in ("ids", "labels"))
        return Block(ids, labels, np.frombuffer(batch.column(side + "xs")[row].as_buffer(), np.float64).reshape(len(ids), -1))

    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = None, None

        def found(types: list[pa.DataType]) -> pa.RecordBatch:
            ok = np.isfinite(best.d2)
            columns = (np.repeat(best.queries.ids, ok.sum(axis=1)), best.ids[ok], best.labels[ok])
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(best.d2[ok])], ["id", "nn_id", "nn_label", "d2"])

        for batch in batches:
            types = [batch.schema.field(name).type.value_type for name in ("ids", "ids", "labels")]
            for row, num in enumerate(batch.column("num").to_pylist()):
                if num != seen:
                    if best:
                        yield found(types)
                    mine = block_of(batch, row, "")
                    mine.x = mine.x.copy()
                    best, seen = Nearest(mine, k), num
                best.see(block_of(batch, row, "b_"), same_label)
        if best:
            yield found(types)

    got = pairs.select("num", "ids", "labels", "xs", "b_ids", "b_labels", "b_xs").mapInArrow(run, f"id {kind['id']}, nn_id {kind['id']}, nn_label {kind['label']}, d2 double")
    top = Window.partitionBy("id").orderBy("d2", "nn_id")
    return got.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def targets(df: DataFrame) -> DataFrame:
    """``label, n, n_new``: how many rows each class lacks to the largest."""
    counts = class_counts(df, "label")
    most = counts.agg(F.max("count").alias("m")).first()["m"] or 0
    return counts.select(F.col("class").alias("label"), F.col("count").alias("n"), (F.lit(most) - F.col("count")).alias("n_new"))


def _draw(*parts) -> F.Column:
    """A number below 2 ** 32 from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def smote(df: DataFrame, k: int = 5, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Synthetic rows ``label, slot, base_id, nn_id, u, features``: x + u * (neighbour - x), the neighbour one of the
    ``k`` nearest of the class. A class needs more than ``k`` rows."""
    want = targets(df)
    small = want.where((F.col("n_new") > 0) & (F.col("n") <= k)).orderBy("label").first()
    if small:
        raise ValueError(f"class {small['label']!r} has {small['n']} rows, oversampling with {k} neighbours needs {k + 1}")
    slots = want.where("n_new > 0").select("label", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_new") - 1)).alias("slot"))
    s = F.lit(str(seed))
    slots = slots.select("label", "slot", (_draw(s, F.lit("base"), F.col("label"), F.col("slot")) % F.col("n") + 1).alias("rn"), (_draw(s, F.lit("near"), F.col("label"), F.col("slot")) % k + 1).alias("rank"), (_draw(s, F.lit("u"), F.col("label"), F.col("slot")) / F.lit(4294967296.0)).alias("u"))
    base = ranked(df, "label", "id", seed).select("label", "rn", F.col("id").alias("base_id"), F.col("features").alias("x"))
    need = df.join(want.where("n_new > 0").select("label"), "label", "left_semi")
    near = nearest(need, k, True, block).select(F.col("id").alias("base_id"), "rank", "nn_id")
    picked = slots.join(base, ["label", "rn"]).join(near, ["base_id", "rank"]).join(df.select(F.col("id").alias("nn_id"), F.col("features").alias("z")), "nn_id")
    mix = F.zip_with("x", "z", lambda a, b: (a.cast("double") + F.col("u") * (b.cast("double") - a.cast("double"))))
    return picked.select("label", "slot", "base_id", "nn_id", "u", mix.alias("features"))


def _votes(df: DataFrame, k: int, block: int, queries: DataFrame | None = None) -> DataFrame:
    """``id, vote``: the most frequent label of the ``k`` nearest rows (the smallest of equals)."""
    counts = nearest(df, k, False, block, queries).groupBy("id", "nn_label").agg(F.count("*").alias("n"))
    least_first = Window.partitionBy("id").orderBy(F.desc("n"), "nn_label")
    return counts.withColumn("r", F.row_number().over(least_first)).where("r = 1").select("id", F.col("nn_label").alias("vote"))


def _smallest(df: DataFrame) -> F.Column:
    smallest = class_counts(df, "label").orderBy("count", "class").first()
    return F.lit(smallest["class"] if smallest else None)


def vote_keeps(df: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """``id, label, vote, keep``: the most frequent label of the ``k`` nearest rows (the smallest of equals); rows of all
    classes but the smallest go if it isn't theirs."""
    keep = (F.col("label") == _smallest(df)) | (F.col("vote") == F.col("label"))
    return df.select("id", "label").join(_votes(df, k, block), "id", "left").select("id", "label", "vote", F.coalesce(keep, F.lit(True)).alias("keep"))


def cleaned(df: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """The rows that ``vote_keeps`` keeps. Rows of the smallest class stay in any case, so their votes aren't taken."""
    asked = df.where(F.col("label") != _smallest(df))
    gone = asked.select("id", "label").join(_votes(df, k, block, asked), "id").where("vote <> label").select("id", "label")
    return df.join(gone, ["id", "label"], "left_anti")


def balance(df: DataFrame, strategy: str, smote_k: int = 5, enn_k: int = 3, seed: int = SEED) -> DataFrame:
    """``id, label, features`` after ``strategy``; ids are text, synthetic rows are named after their slot. Oversampling and
    cleaning pass over their rows several times and so cache them; ``release`` frees the result's cache."""
    plain = df.where(F.col("label").isNotNull()).select(F.col("id").cast("string").alias("id"), "label", F.transform("features", lambda v: v.cast("double")).alias("features"))
    if strategy in ("none", "paper_balanced_subset"):
        return plain
    if strategy not in ("smote", "smoteenn"):
        raise ValueError(f"unsupported strategy {strategy!r}")
    held = [plain.persist()]
    new = smote(plain, smote_k, seed).select(F.concat_ws(":", F.lit("new"), F.col("label").cast("string"), F.col("slot").cast("string")).alias("id"), "label", "features")
    out = plain.unionByName(new)
    if strategy == "smoteenn":
        held.append(out.persist())
        out = cleaned(out, enn_k)
    out._held = held
    return out


def release(balanced: DataFrame) -> None:
    """Free what ``balance`` cached for a result that nothing will read any more."""
    for held in getattr(balanced, "_held", []):
        held.unpersist()
