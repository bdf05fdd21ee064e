"""Training runs: scan, sample, features, balance, fit, tune, evaluate, persist.

Rows are sampled first: features, one Arrow kernel over decoded images, are made of the images that a run uses and are
written once. Fits are groups of a Spark job: one group for each pair of classes of a vector machine, each in a task that
holds its pair's rows and a bounded part of their kernel. Balanced rows are written before they are fitted, since a fit
reads them more than once. The rounds of a coverage run are independent, so their jobs run side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults
from ..functions import learners as L
from ..functions.features import extract, feature_columns
from ..operators import metrics as M
from ..operators import sampling, thresholds
from ..operators.balancing import balance, release
from ..sources import artifacts as A
from ..sources import metadata
from .settings import Run

#: Rounds whose jobs run at the same time.
ROUNDS_AT_ONCE = 4


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf["features"].to_numpy()).astype(np.float64), pdf["label"].to_numpy(dtype=object)


def fit_svm(df: DataFrame, learner: L.Learner, seed: int = 42) -> L.SvmModel:
    """Fit on ``id, label, features`` (a table, as it is read more than once): the scaler from one aggregate, then one task
    for each pair of classes."""
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}  # a row a class
    classes = sorted(counts)
    long = df.select(F.posexplode("features").alias("dim", "v"))
    stats = long.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).toPandas().sort_values("dim")
    scale = np.where(stats["s"] > 0, stats["s"], 1.0)
    scaler = L.Scaler(stats["m"].to_numpy(), scale)
    # After scaling a varying column has variance 1 and a constant one 0, so the variance of all entries is their share.
    width = len(stats)
    gamma = L.gamma_of(learner.gamma, float((stats["s"] > 0).mean()), width)
    total = sum(counts.values())
    weights = {k: total / (len(classes) * n) for k, n in counts.items()}
    pairs = [f"{i},{j}" for i, j in combinations(range(len(classes)), 2)]
    of = F.array(*[F.lit(p) for p in pairs]) if pairs else F.array().cast("array<string>")
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    mine = F.filter(of, lambda p: (F.split(p, ",")[0].cast("int") == index) | (F.split(p, ",")[1].cast("int") == index))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = (int(k) for k in key[0].split(","))
        pdf = pdf.sort_values("id")
        x, y = _arrays(pdf)
        machine = L.fit_pair(scaler(x), y, (classes[i], classes[j]), gamma, learner.c, weights, learner.probability, seed)
        return pd.DataFrame({"pair": [key[0]], "machine": [L.dump_model(machine)]})

    got = df.select("id", "label", "features", F.explode(mine).alias("pair")).groupBy("pair").applyInPandas(fit, "pair string, machine binary").toPandas()
    machines = dict(zip(got["pair"], got["machine"], strict=True))
    return L.SvmModel(classes, scaler, float(gamma), [L.load_model(bytes(machines[p])) for p in pairs])


def fit_mlp(df: DataFrame, learner: L.Learner, seed: int = 42) -> L.MlpModel:
    """Fit on ``id, label, features`` of all rows, in batches, in one task that holds them."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf.sort_values("id"))
        model = L.fit_mlp(x, y, tuple(learner.hidden), learner.alpha, learner.epochs, seed=seed)
        return pd.DataFrame({"model": [L.dump_model(model)]})

    row = df.select("id", "label", "features", F.lit(0).alias("one")).groupBy("one").applyInPandas(fit, "model binary").first()
    return L.load_model(bytes(row["model"]))


def _balanced(df: DataFrame, strategy: str, run: Run, out: A.Artifacts, name: str) -> DataFrame:
    """``df`` after ``strategy``, written to the run's folder for as long as its fit takes."""
    path = f"{out.folder}/balanced_{name}.parquet"
    rows = balance(df, strategy, run.balancing.smote_k, run.balancing.enn_k, run.samples.seed)
    rows.write.mode("overwrite").parquet(path)
    release(rows)
    return df.sparkSession.read.parquet(path)


def fit_one_stage(df: DataFrame, run: Run, out: A.Artifacts):
    rows = _balanced(df, run.balancing.strategy, run, out, "rows")
    model = (fit_mlp if run.learner.kind == "ann" else fit_svm)(rows, run.learner, run.samples.seed)
    out.delete("balanced_rows.parquet")
    return model


def fit_two_stages(df: DataFrame, run: Run, out: A.Artifacts, pivot: str = defaults.PIVOT) -> L.PivotModel:
    """Pivot against the rest, and the rest's classes, each balanced by its own strategy."""
    names = {r["label"] for r in df.select("label").distinct().collect()}
    if pivot not in names or len(names) < 2:
        raise ValueError(f"two stages need the class {pivot!r} and others in the training rows")
    binary = df.withColumn("label", F.when(F.col("label") == pivot, pivot).otherwise("non_" + pivot))
    parts = {"first": (binary, run.decision.first), "second": (df.where(F.col("label") != pivot), run.decision.second)}
    models = [fit_svm(_balanced(rows, strategy, run, out, name), run.learner, run.samples.seed) for name, (rows, strategy) in parts.items()]
    for name in parts:
        out.delete(f"balanced_{name}.parquet")
    return L.PivotModel(*models, pivot, "non_" + pivot)


def predict(df: DataFrame, model, labels: list[str] | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``pred`` and ``probs`` (an array in the order of the model's classes, or of ``labels`` for two stages;
    null without probabilities)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("pred string, probs array<float>")
    def run(features: pd.Series) -> pd.DataFrame:
        own = shared.value
        if not len(features):
            return pd.DataFrame({"pred": pd.Series(dtype=object), "probs": pd.Series(dtype=object)})
        x = np.stack(features.to_numpy()).astype(np.float64)
        if isinstance(own, L.PivotModel):
            p = own.predict_proba(x, labels)
            pred = L.limited_choice(p, labels, limits) if limits else np.array(labels, dtype=object)[p.argmax(axis=1)]
            return pd.DataFrame({"pred": pred, "probs": list(p.astype(np.float32))})
        probs = list(own.predict_proba(x).astype(np.float32)) if own.gives_probabilities else [None] * len(x)
        return pd.DataFrame({"pred": own.predict(x), "probs": probs})

    return df.withColumn("_p", run("features")).select(*df.columns, "_p.pred", "_p.probs")


def evaluate(rows: DataFrame, labels: list[str], out: A.Artifacts, prefix: str = "") -> dict[str, float]:
    """Metrics, report and confusion matrix of ``label, pred`` rows, written to ``out``."""
    spark, name = rows.sparkSession, f"{prefix}_" if prefix else ""
    pairs = rows.select(F.col("label").alias("truth"), "pred")
    table = spark.createDataFrame([(k,) for k in labels], "label string")
    values = {k: float(v) for k, v in M.summary(pairs).first().asDict().items()}
    out.write_json(f"{name}metrics.json", values)
    report = M.report(pairs, table).toPandas()
    order = {k: i for i, k in enumerate([*labels, "accuracy", "macro avg", "weighted avg"])}
    report = report.sort_values("row", key=lambda s: s.map(order))
    out.write_csv(f"{name}classification_report.csv", ["", "precision", "recall", "f1-score", "support"], list(report.itertuples(index=False, name=None)))
    cells = M.confusion_matrix(pairs, table).toPandas().pivot(index="truth", columns="pred", values="n").loc[labels, labels]
    out.write_csv(f"{name}confusion_matrix.csv", ["truth", *labels], [(k, *map(int, row)) for k, row in zip(labels, cells.to_numpy(), strict=True)])
    out.write(f"{name}confusion_matrix.png", A.png(A.heat_map(cells.to_numpy())))
    return values


def _distribution(rows: DataFrame, out: A.Artifacts, name: str) -> None:
    counts = sampling.class_counts(rows, "label").orderBy("class").collect()
    out.write_csv(f"class_distribution_{name}.csv", ["class", "count"], [tuple(r) for r in counts])


def run_split(rows: DataFrame, run: Run, out: A.Artifacts) -> dict[str, float]:
    """One experiment on ``id, label, features, split`` rows."""
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    _distribution(train, out, "train")
    _distribution(val, out, "val")
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
    if run.decision.two_stage:
        d, model = run.decision, fit_two_stages(train, run, out)
        plain = predict(val, model, labels)
        result = evaluate(plain, labels, out, "argmax")
        if d.tune:
            scored = plain.select("id", F.col("label").alias("truth"), "probs").persist()
            limits = thresholds.search(scored, labels, d.minority, d.floor, d.low, d.high, d.steps)
            scored.unpersist()
            result = evaluate(predict(val, model, labels, limits), labels, out, "thresholded")
            out.write_json(A.THRESHOLDS, limits)
    else:
        model = fit_one_stage(train, run, out)
        result = evaluate(predict(val, model), labels, out)
    out.write(A.MODEL, L.dump_model(model))
    out.write_json(A.COLUMNS, feature_columns(run.texture))
    out.write_json(A.LABELS, labels if run.decision.two_stage else model.classes)
    return result


def features_of(spark: SparkSession, run: Run, rows: DataFrame) -> DataFrame:
    """``rows`` (``id, label, image_path`` and others) with ``features``, written to the run's folder and read again. Only their
    images are read."""
    parts = run.tasks if run.tasks > 0 else 4 * spark.sparkContext.defaultParallelism
    chosen = f"{run.out}/images.parquet"
    rows.write.mode("overwrite").parquet(chosen)
    images = metadata.read_images(spark, spark.read.parquet(chosen), run.roots(), parts)
    path = f"{run.out}/features.parquet"
    extract(images, run).drop("image_path").write.mode("overwrite").parquet(path)
    A.Artifacts(spark, run.out).delete("images.parquet")
    return spark.read.parquet(path)


def plan_rounds(rows: DataFrame, run: Run, out: A.Artifacts) -> DataFrame:
    """``round, key, id, label, split`` of all rounds, written once. A row drawn twice is two rows of its round, as in
    sampling with replacement; ``key`` tells them apart."""
    s = run.samples
    drawn = sampling.coverage_rounds(rows, s.per_class, "label", "id", s.max_rounds, s.seed).withColumn("key", F.concat_ws(":", "id", "slot", "refill"))
    path = f"{out.folder}/rounds.parquet"
    drawn.select("round", "key", "id", "label").write.mode("overwrite").parquet(path)
    return out.spark.read.parquet(path)


def run_rounds(plan: DataFrame, features: DataFrame, run: Run, out: A.Artifacts) -> dict:
    """All rounds of a coverage run, some at a time; each round's files go to its own folder."""
    numbers = [r["round"] for r in plan.select("round").distinct().orderBy("round").collect()]
    if not numbers:
        raise ValueError("there is no round: no labelled row")
    vectors = features.select(F.col("id").alias("_id"), "features")

    def one(number: int) -> dict[str, float]:
        own = plan.where(F.col("round") == number)
        folder = A.Artifacts(out.spark, f"{out.folder}/round_{number + 1:03d}")
        split = sampling.split(own.select(F.col("id").alias("_id"), F.col("key").alias("id"), "label"), run.samples, "label", "id")
        result = run_split(split.join(vectors, "_id").select("id", "label", "features", "split"), run, folder)
        folder.write(A.CONFIG, run.to_json())
        return result

    with ThreadPoolExecutor(ROUNDS_AT_ONCE) as pool:
        log = list(zip([n + 1 for n in numbers], pool.map(one, numbers), strict=True))
    out.write_csv("coverage_metrics.csv", ["round", *M.METRICS], [(n, *(m[k] for k in M.METRICS)) for n, m in log])
    table = out.spark.createDataFrame([(n, m["accuracy"], m["f1_macro"]) for n, m in log], "round int, accuracy double, f1_macro double")
    summary = M.rounds_summary(table).first().asDict()
    out.write_json("coverage_summary.json", summary)
    best = A.Artifacts(out.spark, f"{out.folder}/round_{summary['best_round']:03d}")
    for name in (A.MODEL, A.COLUMNS, A.LABELS, A.THRESHOLDS):
        best.copy(name, out)
    out.write(A.CONFIG, run.to_json())
    return summary


def run(spark: SparkSession, settings: Run) -> dict:
    """A whole run; returns its metrics, or the summary of its rounds."""
    settings.checked()
    out = A.Artifacts(spark, str(settings.out))
    rows = metadata.load(spark, settings.metadata(), settings.roots()).select(F.col("image_id").alias("id"), F.col("dx").alias("label"), "image_path")
    if settings.samples.coverage:
        plan = plan_rounds(rows.select("id", "label"), settings, out)
        features = features_of(spark, settings, rows.join(plan.select("id").distinct(), "id", "left_semi"))
        summary = run_rounds(plan, features, settings, out)
        print(f"Coverage training complete\nRounds: {summary['rounds']} | Mean acc: {summary['accuracy_mean']:.4f} | Best acc: {summary['best_accuracy']:.4f}")
        return summary
    result = run_split(features_of(spark, settings, sampling.split(rows, settings.samples, "label", "id")), settings, out)
    out.write(A.CONFIG, settings.to_json())
    print(f"Training complete\nValidation accuracy: {result['accuracy']:.4f}\nValidation balanced_accuracy: {result['balanced_accuracy']:.4f}\nValidation f1_macro: {result['f1_macro']:.4f}")
    return result
