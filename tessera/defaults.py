"""Default values of a run, one table for each record of settings. A record's fields are its table's entries."""

from __future__ import annotations

import dataclasses
from typing import Any

# The defaults of the command line and of the published method.
SAMPLES = {"split": "paper_fixed_count", "per_class": 115, "train": 70, "val": 45, "val_ratio": 0.2, "seed": 42, "coverage": False, "max_rounds": 0}
PREPARATION = {"size": 160, "hair": True, "hair_window": 17, "fill_radius": 3, "light": True, "clip": 2.0, "tiles": (8, 8)}
SEGMENTATION = {"steps": 80, "inside": 1.0, "outside": 1.0}
TEXTURE = {
    "lbp_roi": True, "lbp_bimf1": True, "glcm": True, "hsv": True, "abcd": True,
    "points": 8, "radius": 1, "method": "default", "bins": 256, "window": 5, "smooth": 3,
    "colour_bins": (24, 8, 8), "distances": (1, 2), "angles": (0.0, 0.785398, 1.570796, 2.356194),
}
BALANCING = {"strategy": "paper_balanced_subset", "smote_k": 5, "enn_k": 3}
LEARNER = {"kind": "svm", "c": 6.0, "gamma": "scale", "probability": False, "hidden": (256, 128), "alpha": 1e-4, "epochs": 400}
DECISION = {
    "two_stage": False, "first": "smote", "second": "smoteenn",
    "tune": True, "low": 0.05, "high": 0.95, "steps": 37, "floor": 0.2, "minority": ("akiec", "bcc", "df", "mel", "vasc"),
}
# The class that the first of two stages tells from the others, and where the data set keeps its files.
PIVOT = "nv"
METADATA, IMAGES = "HAM10000_metadata.csv", ("HAM10000_images_part_1", "HAM10000_images_part_2")


def record(name: str, table: dict[str, Any], doc: str) -> type:
    """A frozen dataclass with the entries of ``table`` as fields."""
    fields = [(k, type(v), dataclasses.field(default=v)) for k, v in table.items()]
    made = dataclasses.make_dataclass(name, fields, frozen=True)
    made.__doc__ = doc
    return made
