"""The settings of a run: a record for each part of the work, owned by the module that does it."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from .. import defaults
from ..functions.features import Preparation, Segmentation, Texture
from ..functions.kernels import LBP_METHODS
from ..functions.learners import Learner, gamma_of
from ..operators.balancing import STRATEGIES, Balancing
from ..operators.sampling import SPLITS, Samples
from ..operators.thresholds import Decision

PARTS = {"samples": Samples, "preparation": Preparation, "segmentation": Segmentation, "texture": Texture, "balancing": Balancing, "learner": Learner, "decision": Decision}


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes, how many tasks extract features at once (all cores below 1), and its parts."""

    source: str
    out: str
    tasks: int = -1
    samples: Samples = field(default_factory=Samples)
    preparation: Preparation = field(default_factory=Preparation)
    segmentation: Segmentation = field(default_factory=Segmentation)
    texture: Texture = field(default_factory=Texture)
    balancing: Balancing = field(default_factory=Balancing)
    learner: Learner = field(default_factory=Learner)
    decision: Decision = field(default_factory=Decision)

    def with_(self, **parts: dict[str, Any]) -> Run:
        """A copy with changed entries: ``run.with_(samples={"train": 8})``."""
        return dataclasses.replace(self, **{k: dataclasses.replace(getattr(self, k), **v) for k, v in parts.items()})

    def metadata(self) -> str:
        return f"{self.source}/{defaults.METADATA}"

    def roots(self) -> tuple[str, ...]:
        return tuple(f"{self.source}/{name}" for name in defaults.IMAGES)

    def checked(self) -> Run:
        """This record, or a ValueError that names what can't work."""
        s, t, d = self.samples, self.texture, self.decision
        wrong = [
            (not any(getattr(t, g) for g in t.GROUPS), "no feature group is enabled"),
            (t.method not in LBP_METHODS, f"unsupported pattern method {t.method!r}"),
            (s.split not in SPLITS, f"unsupported split {s.split!r}"),
            (s.split == "stratified_ratio" and not 0 < s.val_ratio < 1, "the validation ratio must lie between 0 and 1"),
            (s.coverage and s.per_class is None, "coverage rounds need a number of rows a class"),
            (self.learner.kind not in ("svm", "ann"), f"unsupported model {self.learner.kind!r}"),
            *((x not in STRATEGIES, f"unsupported strategy {x!r}") for x in (self.balancing.strategy, d.first, d.second)),
            (d.two_stage and self.learner.kind != "svm", "two stages need vector machines"),
            (d.two_stage and not self.learner.probability, "two stages compose probabilities, which are switched off"),
            (d.two_stage and s.coverage, "coverage rounds and two stages can't be combined"),
        ]
        for bad, reason in wrong:
            if bad:
                raise ValueError(reason)
        gamma_of(self.learner.gamma, 1.0, 1)  # text that isn't a number is an error
        return self

    def paper(self) -> Run:
        """The published experiment: both pattern histograms alone, fixed counts, a network, plain images."""
        return self.with_(
            samples={"split": "paper_fixed_count", "per_class": 115, "train": 70, "val": 45, "coverage": False, "max_rounds": 0},
            preparation={"hair": False, "light": False},
            texture={"lbp_roi": True, "lbp_bimf1": True, "glcm": False, "hsv": False, "abcd": False},
            balancing={"strategy": "paper_balanced_subset"}, learner={"kind": "ann"}, decision={"two_stage": False},
        )

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Run:
        """The record with its tuples. Unknown names are an error."""
        tree = json.loads(text)
        for name, kind in PARTS.items():
            if name in tree:
                tree[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in tree[name].items()})
        return cls(**tree)
