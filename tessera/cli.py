"""Command line: ``python -m tessera.cli train ...`` and ``python -m tessera.cli predict ...``."""

from __future__ import annotations

import argparse

from .operators.balancing import STRATEGIES
from .operators.sampling import SPLITS
from .plans.settings import PARTS, Run

#: Flag, part and entry of the settings that it sets. Defaults are the entry's own.
VALUES = (
    ("image-size", "preparation", "size"), ("val-ratio", "samples", "val_ratio"), ("random-state", "samples", "seed"),
    ("cv-iter", "segmentation", "steps"), ("cv-lambda1", "segmentation", "inside"), ("cv-lambda2", "segmentation", "outside"),
    ("smote-k-neighbors", "balancing", "smote_k"), ("enn-k-neighbors", "balancing", "enn_k"),
    ("svm-c", "learner", "c"), ("svm-gamma", "learner", "gamma"), ("ann-alpha", "learner", "alpha"), ("ann-max-iter", "learner", "epochs"),
    ("per-class-limit", "samples", "per_class"), ("train-per-class", "samples", "train"), ("val-per-class", "samples", "val"),
    ("coverage-max-rounds", "samples", "max_rounds"), ("minority-recall-floor", "decision", "floor"),
    ("threshold-min", "decision", "low"), ("threshold-max", "decision", "high"), ("threshold-steps", "decision", "steps"),
)
LISTS = (("ann-hidden", "learner", "hidden", int), ("minority-classes", "decision", "minority", str))
STAGES = [s for s in STRATEGIES if s != "paper_balanced_subset"]
CHOICES = (
    ("imbalance-strategy", "balancing", "strategy", STRATEGIES), ("model", "learner", "kind", ("svm", "ann")), ("split-mode", "samples", "split", SPLITS),
    ("stage1-imbalance-strategy", "decision", "first", STAGES), ("stage2-imbalance-strategy", "decision", "second", STAGES),
)
SWITCHES = (("svm-probability", "learner", "probability"), ("coverage-enabled", "samples", "coverage"), ("two-stage", "decision", "two_stage"))
OFF = (
    ("glcm", "texture", "glcm"), ("hsv", "texture", "hsv"), ("abcd", "texture", "abcd"), ("lbp-roi", "texture", "lbp_roi"), ("lbp-bimf1", "texture", "lbp_bimf1"),
    ("hair-removal", "preparation", "hair"), ("clahe", "preparation", "light"), ("threshold-tuning", "decision", "tune"),
)


def _dest(part: str, entry: str) -> str:
    return f"{part}:{entry}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Interpretable image classification on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train", help="fit and evaluate")
    train.add_argument("--dataset-root", required=True)
    train.add_argument("--output-dir", default="artifacts")
    train.add_argument("--n-jobs", type=int, default=-1, help="tasks that extract features at once; all cores below 1")
    train.add_argument("--paper-mode", action="store_true")
    own = lambda part, entry: getattr(PARTS[part](), entry)
    for flag, part, entry in VALUES:
        train.add_argument(f"--{flag}", dest=_dest(part, entry), type=type(own(part, entry)), default=own(part, entry))
    for flag, part, entry, kind in LISTS:
        train.add_argument(f"--{flag}", dest=_dest(part, entry), type=lambda text, kind=kind: tuple(kind(x.strip()) for x in text.split(",") if x.strip()), default=own(part, entry))
    for flag, part, entry, choices in CHOICES:
        train.add_argument(f"--{flag}", dest=_dest(part, entry), choices=choices, default=own(part, entry))
    for flag, part, entry in SWITCHES:
        train.add_argument(f"--{flag}", dest=_dest(part, entry), action="store_true")
    for flag, part, entry in OFF:
        train.add_argument(f"--disable-{flag}", dest=_dest(part, entry), action="store_false")
    predict = commands.add_parser("predict", help="classify one image")
    predict.add_argument("--artifacts-dir", required=True)
    predict.add_argument("--image-path", required=True)
    return top


def run_of(args: argparse.Namespace) -> Run:
    parts: dict[str, dict] = {}
    for name, value in vars(args).items():
        part, mark, entry = name.partition(":")
        if mark:
            parts.setdefault(part, {})[entry] = value
    if parts["samples"]["per_class"] < 1:
        parts["samples"]["per_class"] = None
    run = Run(args.dataset_root, args.output_dir, args.n_jobs).with_(**parts)
    return run.paper() if args.paper_mode else run


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "train":
        from .plans.training import run

        run(spark, run_of(args))
    else:
        from .plans.inference import as_json, predict_one

        print(as_json(predict_one(spark, args.artifacts_dir, args.image_path)))


if __name__ == "__main__":
    main()
