"""Decisions from class probabilities: composition of two stages, argmax, thresholds and their search.

Probabilities are in long form ``id, cls, p`` with a class index ``k`` for ties (the first class wins)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults
from ..defaults import record
from .metrics import class_scores, pair_counts

Decision = record("Decision", defaults.DECISION, "One stage or two, their strategies, and the search for thresholds.")


def compose_two_stages(stage1: DataFrame, stage2: DataFrame, labels: list[str], pivot: str = "nv", rest: str = "non_nv") -> DataFrame:
    """``id, cls, p`` from ``stage1`` and ``stage2`` (both ``id, cls, p``): the pivot keeps its probability, others have
    that of the rest times their own. Classes outside ``labels`` are left out; rows sum to 1, or stay 0."""
    first = stage1.groupBy("id").agg(F.max(F.when(F.col("cls") == pivot, F.col("p"))).alias("p_pivot"), F.max(F.when(F.col("cls") == rest, F.col("p"))).alias("p_rest"))
    own = first.select("id", F.lit(pivot).alias("cls"), F.col("p_pivot").alias("q"))
    others = stage2.where(F.col("cls") != pivot).join(first, "id").select("id", "cls", (F.col("p_rest") * F.col("p")).alias("q"))
    rows = own.unionByName(others).where(F.col("cls").isin(labels))
    total = rows.groupBy("id").agg(F.sum("q").alias("total"))
    return rows.join(total, "id").select("id", "cls", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("q") / F.nullif(F.col("total"), F.lit(0.0))).alias("p"))


def decide(probs: DataFrame, thresholds: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``id, pred``: the class with the largest p / threshold; 0.5 where there is none, 1e-6 at least."""
    score = F.col("p") / F.greatest(F.lit(0.5), F.lit(1e-6))
    if thresholds is not None:
        probs = probs.join(F.broadcast(thresholds.select("cls", "thr")), "cls", "left")  # one row for each class
        score = F.col("p") / F.greatest(F.coalesce(F.col("thr"), F.lit(0.5)), F.lit(1e-6))
    return probs.groupBy(*by, "id").agg(F.max_by("cls", F.struct(score.alias("s"), (-F.col("k")).alias("o"))).alias("pred"))


def grid(low: float = 0.05, high: float = 0.95, steps: int = 37) -> list[float]:
    return np.linspace(low, high, steps).tolist()


def objectives(scored: DataFrame, target: str, k_target: int, thresholds: dict[str, float], labels: list[str], minority: tuple[str, ...], floor: float, points: list[float]) -> DataFrame:
    """``thr, objective`` for each point of the grid, put in place of the threshold of ``target``. ``scored`` has
    ``id, truth, probs`` (an array in the order of ``labels``). Only two classes can win for a row: the target, or the
    best of the others, which doesn't depend on the grid. So each row is one pair of scores and the grid is an array."""
    limits = [max(float(thresholds.get(c, 0.5)), 1e-6) for c in labels]
    others = [F.struct((F.col("probs")[k].cast("double") / limits[k]).alias("s"), F.lit(-k).alias("o"), F.lit(c).alias("c")) for k, c in enumerate(labels) if k != k_target]
    best = F.greatest(*others) if len(others) > 1 else others[0] if others else F.lit(None).cast("struct<s:double,o:int,c:string>")
    rows = scored.select("truth", F.col("probs")[k_target].cast("double").alias("p"), best.alias("b"))
    rows = rows.select("truth", "p", "b", F.posexplode(F.array(*[F.lit(float(x)) for x in points])).alias("g", "thr"))
    mine = F.struct((F.col("p") / F.greatest(F.col("thr"), F.lit(1e-6))).alias("s"), F.lit(-k_target).alias("o"), F.lit(target).alias("c"))
    pred = F.when(F.col("b").isNull() | (mine > F.col("b")), F.lit(target)).otherwise(F.col("b.c"))
    counts = pair_counts(rows.select("g", "thr", "truth", pred.alias("pred")), by=("g", "thr"))
    scores = class_scores(counts, by=("g", "thr")).where(F.col("class").isin(labels))
    penalty = F.lit(0.0)
    if target in minority:
        recall = F.coalesce(F.max(F.when(F.col("class") == target, F.col("recall"))), F.lit(0.0))
        penalty = F.greatest(F.lit(0.0), F.lit(float(floor)) - recall)
    return scores.groupBy("g", "thr").agg((F.sum("f1") / len(labels) - penalty).alias("objective"))


def search(scored: DataFrame, labels: list[str], minority: tuple[str, ...], floor: float = 0.2, low: float = 0.05, high: float = 0.95, steps: int = 37) -> dict[str, float]:
    """One pass over the classes, minority first: the lowest grid point with the best objective. One job a class."""
    points, best = grid(low, high, steps), dict.fromkeys(labels, 0.5)
    for target in [c for c in labels if c in minority] + [c for c in labels if c not in minority]:
        rows = objectives(scored, target, labels.index(target), best, labels, minority, floor, points)
        top = rows.orderBy(F.desc(F.round("objective", 12)), "g").select("thr").first()
        if top:
            best[target] = top["thr"]
    return best


def as_table(spark: SparkSession, thresholds: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(thresholds.items()), "cls string, thr double")
