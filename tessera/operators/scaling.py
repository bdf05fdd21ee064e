"""Statistics of feature vectors ``id, label, features``: z-scores, kernel width, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import class_counts


def feature_stats(df: DataFrame) -> DataFrame:
    """``dim, mean, std`` (population) of each position of the vectors."""
    long = df.select(F.posexplode("features").alias("dim", "v"))
    return long.groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))


def scaled(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with z-scored ``features``; constant positions are only centred. ``stats`` has one row for each position
    and is folded into two arrays."""
    rows = stats.orderBy("dim").collect()
    mean = F.array(*[F.lit(float(r["mean"])) for r in rows])
    scale = F.array(*[F.lit(float(r["std"]) or 1.0) for r in rows])
    centred = F.zip_with("features", mean, lambda v, m: v.cast("double") - m)
    return df.withColumn("features", F.zip_with(centred, scale, lambda v, s: v / s))


def gamma_scale(df: DataFrame) -> DataFrame:
    """``gamma``: 1 / (positions * variance of all entries)."""
    long = df.select(F.posexplode("features").alias("dim", "v"))
    return long.agg((1 / ((F.max("dim") + 1) * F.var_pop(F.col("v").cast("double")))).alias("gamma"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``class, weight``: rows / (classes * rows of the class)."""
    counts = class_counts(df, label)
    total = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k")).first()
    return counts.select("class", (F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"] or 1)) * F.col("count"))).alias("weight"))
