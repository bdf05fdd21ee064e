"""Learners in NumPy: scaler, RBF support vector machine with calibrated probabilities, multi-layer perceptron. Each fit
is a plain function of arrays, so independent fits run as groups of a Spark job."""

from __future__ import annotations

import json
import zipfile
from collections import OrderedDict
from dataclasses import dataclass, field
from io import BytesIO
from itertools import combinations

import numpy as np

from .. import defaults
from ..defaults import record

#: Bytes of kernel rows that a fit keeps.
KERNEL_BYTES = 256 << 20

Learner = record("Learner", defaults.LEARNER, "Vector machine (svm) or network (ann), and its settings.")


@dataclass
class Scaler:
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray) -> Scaler:
        """Population deviation; a constant column is only centred."""
        x = np.asarray(x, dtype=np.float64)
        std = x.std(axis=0)
        return cls(x.mean(axis=0), np.where(std > 0, std, 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        if x.shape[-1] != len(self.mean):
            raise ValueError(f"{x.shape[-1]} features, the model has {len(self.mean)}")
        return (x - self.mean) / self.scale


def gamma_of(setting: str | float, spread: float, columns: int) -> float:
    """``scale``: 1 / (columns * variance of all entries, ``spread``); ``auto``: 1 / columns; or the number itself."""
    if setting == "scale":
        return 1 / (columns * spread) if spread else 1.0
    return 1 / columns if setting == "auto" else float(setting)


def class_weights(y: np.ndarray) -> dict:
    """Balanced: rows / (classes * rows of the class)."""
    names, n = np.unique(y, return_counts=True)
    return {k: len(y) / (len(names) * c) for k, c in zip(names.tolist(), n.tolist(), strict=True)}


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


class KernelRows:
    """Rows of the kernel matrix of ``x`` with itself, made when asked for; the last ones used are kept, within ``limit``
    bytes, so that no fit needs the whole matrix."""

    def __init__(self, x: np.ndarray, gamma: float, limit: int = KERNEL_BYTES):
        self.x, self.gamma = x, gamma
        self.square = (x**2).sum(axis=1)
        self.room, self.rows = max(2, limit // max(1, 8 * len(x))), OrderedDict()

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.rows:
            self.rows.move_to_end(i)
            return self.rows[i]
        if len(self.rows) >= self.room:
            self.rows.popitem(last=False)
        row = np.exp(-self.gamma * np.maximum(self.square + self.square[i] - 2 * self.x @ self.x[i], 0))
        self.rows[i] = row
        return row


def smo(kernel: np.ndarray | KernelRows, y: np.ndarray, limit: np.ndarray, tol: float = 1e-3, steps: int = 10_000_000) -> tuple[np.ndarray, float]:
    """Dual variables and bias of a two-class machine, 0 <= alpha <= limit, by sequential minimal optimisation: at each
    step the pair that violates optimality most, the second one by the gain it promises. Kernels have ones on their
    diagonal. A machine that isn't optimal after ``steps`` is an error."""
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        value = -y * grad
        up = np.where(y > 0, alpha < limit - 1e-12, alpha > 1e-12)
        low = np.where(y > 0, alpha > 1e-12, alpha < limit - 1e-12)
        if not up.any() or not low.any():
            break
        i = int(np.argmax(np.where(up, value, -np.inf)))
        gap = value[i] - value
        if gap[low].max() < tol:
            break
        of_i = kernel[i]
        curve = np.maximum(2 - 2 * of_i, 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap**2 / curve, -np.inf)))
        # Move along the constraint sum(y * alpha) = const.
        room_i = limit[i] - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else limit[j] - alpha[j]
        step = min(gap[j] / curve[j], room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += y * (of_i - kernel[j]) * step
    else:
        raise RuntimeError(f"the machine isn't optimal after {steps} steps")
    value = -y * grad
    free = (alpha > 1e-9) & (alpha < limit - 1e-9)
    if free.any():
        return alpha, float(value[free].mean())
    up = np.where(y > 0, alpha < limit - 1e-12, alpha > 1e-12)
    low = np.where(y > 0, alpha > 1e-12, alpha < limit - 1e-12)
    high = value[up].max() if up.any() else value.max()
    least = value[low].min() if low.any() else value.min()
    return alpha, float((high + least) / 2)


def sigmoid_targets(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Smoothed targets of labels (positive or not), and the offset that fits them without scores."""
    n1 = int((y > 0).sum())
    n0 = len(y) - n1
    return np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), float(np.log((n0 + 1) / (n1 + 1)))


def sigmoid_move(scores: np.ndarray, t: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log loss of 1 / (1 + exp(a * score + b)) and the Newton step from there."""
    p = 1 / (1 + np.exp(np.clip(a * scores + b, -500, 500)))
    d, w = t - p, np.maximum(p * (1 - p), 1e-12)
    g = np.array([(scores * d).sum(), d.sum()])
    h = np.array([[(scores**2 * w).sum() + 1e-12, (scores * w).sum()], [(scores * w).sum(), w.sum() + 1e-12]])
    return g, -np.linalg.solve(h, g)


def platt(scores: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of the sigmoid 1 / (1 + exp(a * score + b)), by damped Newton steps on smoothed targets."""
    t, offset = sigmoid_targets(y)
    at = np.array([0.0, offset])

    def loss(ab: np.ndarray) -> float:
        z = ab[0] * scores + ab[1]
        return float((np.logaddexp(0, z) - (1 - t) * z).sum())

    now = loss(at)
    for _ in range(steps):
        g, move = sigmoid_move(scores, t, *at)
        if np.abs(g).max() < 1e-5:
            break
        size = 1.0
        while size > 1e-10 and loss(at + size * move) >= now + 1e-4 * size * float(g @ move):
            size /= 2
        if size <= 1e-10:
            break
        at = at + size * move
        now = loss(at)
    return float(at[0]), float(at[1])


def couple(pairwise: np.ndarray) -> np.ndarray:
    """Class probabilities (n, k) from pairwise ones r[n, i, j] = P(i | i or j): the minimum of the sum of
    (r_ji p_i - r_ij p_j) ** 2 over distributions, from its linear system."""
    n, k, _ = pairwise.shape
    r = pairwise * (1 - np.eye(k))
    q = -r.swapaxes(1, 2) * r
    q[:, np.arange(k), np.arange(k)] = (r.swapaxes(1, 2) ** 2).sum(axis=2)
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k] = q + 1e-12 * np.eye(k)
    system[:, :k, k] = system[:, k, :k] = 1
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1
    p = np.clip(np.linalg.solve(system, right)[:, :k, 0], 0, None)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class PairMachine:
    """The machine that tells ``classes[0]`` (positive) from ``classes[1]``."""

    classes: tuple[str, str]
    vectors: np.ndarray
    coef: np.ndarray
    bias: float
    sigmoid: tuple[float, float] | None = None


def fit_pair(x: np.ndarray, y: np.ndarray, classes: tuple[str, str], gamma: float, c: float, weights: dict, probability: bool, seed: int = 42, folds: int = 5) -> PairMachine:
    """``x`` scaled, ``y`` names. With ``probability`` the sigmoid is fitted on scores of held-out folds."""
    sign = np.where(y == classes[0], 1.0, -1.0)
    limit = c * np.array([weights[k] for k in y.tolist()])
    alpha, bias = smo(KernelRows(x, gamma), sign, limit)
    keep = alpha > 1e-9
    machine = PairMachine(tuple(classes), x[keep], (alpha * sign)[keep], bias)
    if probability:
        fold = np.empty(len(y), dtype=int)
        fold[np.random.default_rng(seed).permutation(len(y))] = np.arange(len(y)) % folds
        scores = np.zeros(len(y))
        for f in range(folds):
            test, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if not len(test):
                continue
            if len(np.unique(sign[train])) < 2:
                scores[test] = sign[train][0] if len(train) else 0
                continue
            a, b = smo(KernelRows(x[train], gamma), sign[train], limit[train])
            own = a > 1e-9
            held, weight = x[train][own], (a * sign[train])[own]
            for part in np.array_split(test, -(-len(test) * max(1, len(held)) // (KERNEL_BYTES // 8))):
                scores[part] = rbf(x[part], held, gamma) @ weight + b
        machine.sigmoid = platt(scores, sign)
    return machine


@dataclass
class SvmModel:
    """One-against-one machines; votes decide, ties go to the first class."""

    classes: list[str]
    scaler: Scaler
    gamma: float
    machines: list[PairMachine]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.scaler(x)
        return np.stack([rbf(z, m.vectors, self.gamma) @ m.coef + m.bias if len(m.coef) else np.full(len(z), m.bias) for m in self.machines], axis=1) if self.machines else np.zeros((len(z), 0))

    @property
    def gives_probabilities(self) -> bool:
        return all(m.sigmoid is not None for m in self.machines)

    def predict(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(x), len(self.classes)))
        for m, s in zip(self.machines, self.scores(x).T, strict=True):
            i, j = (self.classes.index(k) for k in m.classes)
            votes[:, i] += s > 0
            votes[:, j] += s <= 0
        return np.array(self.classes, dtype=object)[votes.argmax(axis=1)]

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        """The largest probability and the vote may disagree: they are separate estimates."""
        if not self.gives_probabilities:
            raise ValueError("the model was fitted without probabilities")
        r = np.full((len(x), len(self.classes), len(self.classes)), 0.5)
        for m, s in zip(self.machines, self.scores(x).T, strict=True):
            i, j = (self.classes.index(k) for k in m.classes)
            p = np.clip(1 / (1 + np.exp(np.clip(m.sigmoid[0] * s + m.sigmoid[1], -500, 500))), 1e-7, 1 - 1e-7)
            r[:, i, j], r[:, j, i] = p, 1 - p
        return couple(r) if len(self.classes) > 1 else np.ones((len(x), 1))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 6.0, gamma: str | float = "scale", probability: bool = False, seed: int = 42) -> SvmModel:
    y = np.asarray(y, dtype=object)
    scaler, classes = Scaler.fit(x), sorted(set(y.tolist()))
    z = scaler(x)
    g, weights = gamma_of(gamma, float(z.var()), z.shape[1]), class_weights(y.astype(str))
    machines = []
    for a, b in combinations(classes, 2):
        of = (y == a) | (y == b)
        machines.append(fit_pair(z[of], y[of], (a, b), g, c, weights, probability, seed))
    return SvmModel(classes, scaler, g, machines)


@dataclass
class MlpModel:
    classes: list[str]
    scaler: Scaler
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    gives_probabilities = True

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.scaler(x), self.layers)[-1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.classes, dtype=object)[self.predict_proba(x).argmax(axis=1)]


def _forward(x: np.ndarray, layers: list) -> list[np.ndarray]:
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        if k < len(layers) - 1:
            out.append(np.maximum(z, 0))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
    return out


def mlp_gradients(x: np.ndarray, target: np.ndarray, layers: list, alpha: float) -> tuple[float, list]:
    """Mean log loss with L2 / 2 per row, and its gradients."""
    acts, n = _forward(x, layers), len(x)
    loss = -(target * np.log(acts[-1] + 1e-12)).sum() / n + alpha * sum((w**2).sum() for w, _ in layers) / 2 / n
    grads, back = [], (acts[-1] - target) / n
    for k in range(len(layers) - 1, -1, -1):
        grads.append((acts[k].T @ back + alpha * layers[k][0] / n, back.sum(axis=0)))
        if k:
            back = (back @ layers[k][0].T) * (acts[k] > 0)
    return float(loss), grads[::-1]


def fit_mlp(x: np.ndarray, y: np.ndarray, hidden: tuple[int, ...] = (256, 128), alpha: float = 1e-4, epochs: int = 400, patience: int = 20, seed: int = 42, rate: float = 1e-3, held: float = 0.1, tol: float = 1e-4) -> MlpModel:
    """ReLU layers, Adam, batches of at most 200, early stopping on the accuracy of a held-out tenth of each class."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype=object)
    classes, scaler = sorted(set(y.tolist())), Scaler.fit(x)
    z, code = scaler(x), np.searchsorted(np.array(classes), y.astype(str))
    order = rng.permutation(len(z))
    rank = np.empty(len(z), dtype=int)
    for c in range(len(classes)):
        own = order[code[order] == c]
        rank[own] = np.arange(len(own)) < round(held * len(own))
    val, train = np.flatnonzero(rank == 1), np.flatnonzero(rank == 0)
    if not len(val):
        val = train
    sizes = [z.shape[1], *hidden, len(classes)]
    layers = [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), rng.uniform(-1, 1, b) * np.sqrt(6 / (a + b))) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    target = np.eye(len(classes))[code]
    m = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    v = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    best, kept, stale, t = -np.inf, layers, 0, 0
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for k in range(0, len(mixed), 200):
            rows = mixed[k : k + 200]
            _, grads = mlp_gradients(z[rows], target[rows], layers, alpha)
            t += 1
            step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            m = [tuple(0.9 * a + 0.1 * g for a, g in zip(ms, gs, strict=True)) for ms, gs in zip(m, grads, strict=True)]
            v = [tuple(0.999 * a + 0.001 * g * g for a, g in zip(vs, gs, strict=True)) for vs, gs in zip(v, grads, strict=True)]
            layers = [tuple(p - step * a / (np.sqrt(b) + 1e-8) for p, a, b in zip(ps, ms, vs, strict=True)) for ps, ms, vs in zip(layers, m, v, strict=True)]
        score = float((_forward(z[val], layers)[-1].argmax(axis=1) == code[val]).mean())
        stale = 0 if score > best + tol else stale + 1
        if score > best:
            best, kept = score, layers
        if stale > patience:
            break
    return MlpModel(classes, scaler, [tuple(p) for p in kept])


@dataclass
class PivotModel:
    """``first`` tells the pivot from the rest, ``second`` the rest's classes."""

    first: SvmModel
    second: SvmModel
    pivot: str = "nv"
    rest: str = "non_nv"

    def predict_proba(self, x: np.ndarray, labels: list[str]) -> np.ndarray:
        p1, p2 = self.first.predict_proba(x), self.second.predict_proba(x)
        out = np.zeros((len(x), len(labels)))
        if self.pivot in labels:
            out[:, labels.index(self.pivot)] = p1[:, self.first.classes.index(self.pivot)]
        for k, name in enumerate(self.second.classes):
            if name in labels:
                out[:, labels.index(name)] = p1[:, self.first.classes.index(self.rest)] * p2[:, k]
        total = out.sum(axis=1, keepdims=True)
        return (out / np.where(total > 0, total, 1)).astype(np.float32)


def limited_choice(probs: np.ndarray, labels: list[str], thresholds: dict[str, float]) -> np.ndarray:
    limit = np.array([max(float(thresholds.get(c, 0.5)), 1e-6) for c in labels])
    return np.array(labels, dtype=object)[(probs / limit).argmax(axis=1)]


# Persistence: arrays in an .npz, the rest in JSON beside them. Loading never runs code.


def _pack(value, arrays: dict) -> object:
    if isinstance(value, np.ndarray):
        arrays[f"a{len(arrays)}"] = value
        return {"array": f"a{len(arrays) - 1}"}
    if isinstance(value, (Scaler, PairMachine, SvmModel, MlpModel, PivotModel)):
        return {"kind": type(value).__name__, "fields": {k: _pack(v, arrays) for k, v in vars(value).items()}}
    if isinstance(value, (list, tuple)):
        return {"list": [_pack(v, arrays) for v in value]}
    return {"value": value}


def _unpack(node: dict, arrays) -> object:
    if "array" in node:
        return arrays[node["array"]]
    if "list" in node:
        return [_unpack(v, arrays) for v in node["list"]]
    if "kind" in node:
        kinds = {c.__name__: c for c in (Scaler, PairMachine, SvmModel, MlpModel, PivotModel)}
        return kinds[node["kind"]](**{k: _unpack(v, arrays) for k, v in node["fields"].items()})
    return node["value"]


def dump_model(model) -> bytes:
    arrays: dict[str, np.ndarray] = {}
    tree, buffer, out = _pack(model, arrays), BytesIO(), BytesIO()
    np.savez(buffer, **arrays)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("model.json", json.dumps(tree))
        z.writestr("arrays.npz", buffer.getvalue())
    return out.getvalue()


def load_model(data: bytes):
    with zipfile.ZipFile(BytesIO(data)) as z, np.load(BytesIO(z.read("arrays.npz")), allow_pickle=False) as arrays:
        return _unpack(json.loads(z.read("model.json")), arrays)
