"""Per-class samples, splits and rounds. Random order is the MD5 of seed and id, so any engine can repeat it.

Full ranks within a class come from windows over (class, first three digits of the MD5) plus the counts of the buckets
before, so no class meets in one task. Ranks that are only compared with a small constant use a plain window, whose limit
Spark applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import defaults
from ..defaults import record

SEED = 42
_DIGITS = 3
SPLITS = ("paper_fixed_count", "stratified_ratio")
#: Up to this limit Spark cuts a class before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
SMALL_LIMIT = 1000

Samples = record("Samples", defaults.SAMPLES, "Which rows take part: limits, splits and rounds. ``per_class`` None means all.")


def random_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """``class, count`` by class; null labels are left out."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("count"))


def first_per_class(df: DataFrame, n: int, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """The first ``n`` rows of each class in random order, with ``rn``."""
    if n > SMALL_LIMIT:
        return ranked(df, label, id_col, seed).where(F.col("rn") <= n)
    order = Window.partitionBy(label).orderBy(random_key(id_col, seed), id_col)
    return df.where(F.col(label).isNotNull()).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def limit_per_class(df: DataFrame, limit: int | None, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """At most ``limit`` rows of each class, all without a limit."""
    if limit is None:
        return df.where(F.col(label).isNotNull())
    return first_per_class(df, limit, label, id_col, seed).drop("rn")


def ranked(df: DataFrame, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """All rows with ``rn``, their rank in the random order of their class."""
    keyed = df.where(F.col(label).isNotNull()).withColumn("_key", random_key(id_col, seed)).withColumn("_bucket", F.substring("_key", 1, _DIGITS))
    sizes = keyed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(label, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(label, "_bucket").orderBy("_key", id_col)
    out = keyed.withColumn("_rn", F.row_number().over(inner)).join(sizes, [label, "_bucket"])
    return out.withColumn("rn", F.col("_rn") + F.col("_before")).drop("_key", "_bucket", "_rn", "_before")


def fixed_split(df: DataFrame, train: int, val: int, label: str, id_col: str, limit: int | None = None, seed: int = SEED, check: bool = True) -> DataFrame:
    """Exactly ``train`` and ``val`` rows of each class, marked in ``split``. A class with fewer is an error."""
    if check:
        short = class_counts(limit_per_class(df, limit, label, id_col, seed), label).where(F.col("count") < train + val).orderBy("class").first()
        if short:
            raise ValueError(f"class {short['class']!r} has {short['count']} rows, the split needs {train + val}; lower the counts or use split_mode='stratified_ratio'")
    rows = first_per_class(df, min(train + val, limit or train + val), label, id_col, seed)
    return rows.withColumn("split", F.when(F.col("rn") <= train, "train").otherwise("val")).drop("rn")


def allocate(counts: DataFrame, ratio: float, label: str) -> DataFrame:
    """``label, n_val``: the validation rows of each class, ceil(ratio * n) in all, shares by largest remainder (ties
    to the larger class, then by name). One row for each class."""
    total = counts.agg(F.sum("count").alias("t")).first()["t"] or 0
    want = -int(-total * ratio // 1)
    share = F.col("count") * F.lit(want) / F.lit(max(total, 1))
    base = counts.select(F.col("class").alias(label), F.floor(share).alias("_base"), (share - F.floor(share)).alias("_rest"), F.col("count").alias("_n"))
    left = want - (base.agg(F.sum("_base").alias("s")).first()["s"] or 0)
    order = Window.orderBy(F.desc(F.round("_rest", 9)), F.desc("_n"), label)
    return base.withColumn("_k", F.row_number().over(order)).select(label, (F.col("_base") + F.when(F.col("_k") <= left, 1).otherwise(0)).cast("long").alias("n_val"))


def ratio_split(df: DataFrame, ratio: float, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """A split that keeps class proportions exactly; the first rows of each class in random order validate."""
    share = allocate(class_counts(df, label), ratio, label)
    # one row for each class
    return ranked(df, label, id_col, seed).join(share, label).withColumn("split", F.when(F.col("rn") <= F.col("n_val"), "val").otherwise("train")).drop("rn", "n_val")


def split(df: DataFrame, samples: Samples, label: str = "dx", id_col: str = "image_id") -> DataFrame:
    if samples.split == "paper_fixed_count":
        return fixed_split(df, samples.train, samples.val, label, id_col, samples.per_class, samples.seed)
    if samples.split == "stratified_ratio":
        return ratio_split(df, samples.val_ratio, label, id_col, samples.seed)
    raise ValueError(f"unsupported split {samples.split!r}")


def coverage_rounds(df: DataFrame, per_class: int | None, label: str, id_col: str, max_rounds: int = 0, seed: int = SEED, unique: bool = False) -> DataFrame:
    """Rows ``round, slot, label, id, refill`` of balanced rounds. Each class is cut, in random order, into chunks of
    ``per_class`` rows, one a round; a short or used-up class is filled from itself, with replacement. Refill picks the
    row of rank 1 + (MD5 prefix of seed, class, round and slot modulo the class size). ``unique`` leaves refills out."""
    if per_class is None:
        raise ValueError("coverage rounds need per_class_limit")
    order = ranked(df, label, id_col, seed).select(label, F.col(id_col).alias("id"), "rn")
    counts = class_counts(df, label).select(F.col("class").alias(label), F.col("count").alias("n"))
    most = counts.agg(F.max("n").alias("m")).first()["m"] or 0
    rounds = -(-most // per_class)
    if max_rounds > 0:
        rounds = min(rounds, max_rounds)
    chunk = order.withColumn("round", F.floor((F.col("rn") - 1) / per_class).cast("int")).where(F.col("round") < rounds)
    chunk = chunk.select("round", ((F.col("rn") - 1) % per_class).cast("int").alias("slot"), label, "id", F.lit(False).alias("refill"))
    if unique or not rounds:
        return chunk
    # Slots beyond the class: (round, slot) with round * per_class + slot >= n. An equi-join on the picked rank.
    empty = counts.select(label, "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    first = F.greatest(F.lit(0), F.col("n") - F.col("round") * per_class)
    empty = empty.where(first < per_class).select(label, "n", "round", F.explode(F.sequence(first.cast("int"), F.lit(per_class - 1))).alias("slot"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col(label).cast("string"), F.col("round").cast("string"), F.col("slot").cast("string"))
    pick = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n") + 1
    filled = empty.withColumn("rn", pick).join(order, [label, "rn"]).select("round", "slot", label, "id", F.lit(True).alias("refill"))
    return chunk.unionByName(filled)


def label_index(df: DataFrame, label: str) -> DataFrame:
    """``label, idx``: sorted distinct labels, numbered from 0."""
    names = df.where(F.col(label).isNotNull()).select(label).distinct()
    return names.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("idx"))
