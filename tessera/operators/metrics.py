"""Evaluation of (truth, prediction) rows. All figures derive from the pair counts, one small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro")


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, truth: str = "truth", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: DataFrame | None = None, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``truth, pred, n`` over all pairs of labels, zeros included. ``labels`` has one column; by default the labels are
    those seen. The grid is made of one array of labels, so it has as many rows as labels squared."""
    counts = pair_counts(df, truth, pred)
    if labels is None:
        labels = counts.select(F.col("truth").alias("label")).union(counts.select("pred")).distinct()
    names = labels.agg(F.sort_array(F.collect_set(labels.columns[0])).alias("names"))
    grid = names.select(F.explode("names").alias("truth"), "names").select("truth", F.explode("names").alias("pred"))
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_scores(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``class, tp, support, predicted, precision, recall, f1`` for classes seen in truth or prediction."""
    rows = counts.select(*by, F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("r")).select(*by, "r.*")
    sums = rows.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    return sums.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support")), "f1": _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))})


def summary(df: DataFrame, truth: str = "truth", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """The five metrics, one row (for each ``by``). Macro means run over classes seen in truth or prediction, balanced
    accuracy over those in truth."""
    scores = class_scores(pair_counts(df, truth, pred, by), by)
    return scores.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"),
    )


def report(df: DataFrame, labels: DataFrame | None = None, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``row, precision, recall, f1, support``: each label, then ``accuracy`` (in every score column), ``macro avg`` and
    ``weighted avg``."""
    scores = class_scores(pair_counts(df, truth, pred))
    if labels is not None:
        name = labels.columns[0]
        scores = labels.select(F.col(name).alias("class")).join(scores, "class", "left").na.fill(0)
    scores = scores.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support", "tp")
    total = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")]
    rows = scores.drop("tp")
    mean = scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")).select(F.lit("macro avg").alias("row"), "*")
    weight = scores.agg(*weighted, total.alias("support")).select(F.lit("weighted avg").alias("row"), "*")
    right = (F.sum("tp") / total).alias("a")
    accuracy = scores.agg(right, total.alias("support")).select(F.lit("accuracy").alias("row"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    return rows.unionByName(accuracy).unionByName(mean).unionByName(weight)


def rounds_summary(metrics: DataFrame) -> DataFrame:
    """Six figures over rows ``round, accuracy, f1_macro``: the first of the best rounds wins."""
    return metrics.agg(
        F.count("*").alias("rounds"), F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("f1_macro").alias("f1_macro_mean"), F.max_by("round", F.struct("accuracy", -F.col("round"))).alias("best_round"), F.max("accuracy").alias("best_accuracy"),
    )
