"""Language identification with averaged hashed subword embeddings and a linear softmax.

Subwords are the byte windows of 3 and 4 bytes of the case-folded text whose inner bytes belong to one word; a word's
edges take part as spaces. Each is hashed to one of ``BUCKETS`` embeddings; a text is the average of its subwords'
embeddings, and a linear softmax on it gives the languages. Both layers are trained together by stochastic gradient
descent. As averaging and the linear layer commute, a trained model is one score per bucket and language, and a text's
scores are the mean over its subwords. Probabilities are calibrated by a temperature fitted on rows kept from the
training, and a prediction is rejected if its probability is below the point where the kept rows reach ``precision``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, crc_of_id, map_batches, slices, text_buffer

BUCKETS, DIM = 1 << 15, 16
SIZES = (3, 4)
#: Labelled documents that the model is fitted on at most, and their text bytes. A document's features are at most two
#: numbers for each byte of text, so what the driver holds of the sample is bounded too.
SAMPLE_ROWS, SAMPLE_BYTES = 2048, 16 << 20
UNKNOWN = "und"

_fold = np.arange(256, dtype=np.uint8)
_fold[:0x80] = 0x20
for _c in range(26):
    _fold[0x41 + _c] = _fold[0x61 + _c] = 0x61 + _c


class Model(NamedTuple):
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages), float32
    bias: np.ndarray
    temperature: float
    threshold: float  # calibrated: accept a prediction from this probability on


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the buckets of all subwords of all texts, and how many each text has. ``data`` is padded by 8
    bytes or more."""
    n = int(offsets[-1])
    folded = _fold[data]
    # Two-byte letters U+00C0 to U+00DE are folded like ASCII ones.
    upper = np.flatnonzero((folded[:n] >= 0x80) & (folded[:n] <= 0x9E) & (folded[:n] != 0x97))
    upper = upper[(upper > 0) & (folded[upper - 1] == 0xC3)]
    folded[upper] += 0x20
    folded[n:] = 0x20
    word = np.ndarray(shape=(len(folded) - 3,), dtype="<u4", buffer=folded.data, strides=(1,))[:n]
    letter = folded[: n + 2] != 0x20
    for size in SIZES:
        ok = letter[1 : n + 1] & (letter[2 : n + 2] if size == 4 else True)
        for k in range(1, size):  # windows that would leave their text
            ok[offsets[1:][offsets[1:] >= k] - k] = False
        at = np.flatnonzero(ok)
        with np.errstate(over="ignore"):
            key = (word[at] & np.uint32((1 << (8 * size)) - 1)) * np.uint32(0x9E3779B1) ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
            key = (key ^ key >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        yield (key >> np.uint32(17)).astype(np.int32), np.diff(np.searchsorted(at, offsets))


def counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts for each text."""
    keys = [np.repeat(np.arange(len(column), dtype=np.int64), n) * BUCKETS + bucket for bucket, n in subwords(*text_buffer(column))]
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    ends = np.searchsorted(key, np.arange(len(column) + 1) * BUCKETS)
    return [((key[a:b] % BUCKETS).astype(np.int32), n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script; null has none."""
    plain = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False)
    return plain.to_numpy(zero_copy_only=False).astype(bool)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature_of(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least log loss, by a grid and its refinement. Targets are smoothed by one pseudo-error,
    so that a faultless small set doesn't make every prediction certain."""
    n, kinds = logits.shape
    wanted = np.full((n, kinds), 1 / (n + 2) / max(kinds - 1, 1))
    wanted[np.arange(n), target] = 1 - 1 / (n + 2)
    grid = np.geomspace(0.05, 20, 41)
    for _ in range(3):
        loss = [-(wanted * np.log(softmax(logits / t) + 1e-12)).sum(axis=1).mean() for t in grid]
        k = int(np.argmin(loss))
        grid = np.geomspace(grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], 21)
    return float(grid[10])


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, rate: float = 2.0, batch: int = 32, precision: float = 0.99, seed: int = 42) -> Model:
    """Train on (distinct buckets, counts) of texts. Every eighth row calibrates and isn't trained on."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    usable = [i for i, (b, _) in enumerate(features) if len(b)]
    if not usable:
        return Model(names or [UNKNOWN], np.zeros((BUCKETS, max(1, len(names))), np.float32), np.zeros(max(1, len(names))), 1.0, 1.0)
    y = np.array([names.index(labels[i]) for i in usable])
    x = [(features[i][0], (features[i][1] / features[i][1].sum()).astype(np.float32)) for i in usable]
    order = rng.permutation(len(x))
    held, train = (order[::8], np.setdiff1d(order, order[::8])) if len(x) >= 16 else (order, order)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            ids, weight = np.concatenate([x[i][0] for i in rows]), np.concatenate([x[i][1] for i in rows])
            of = np.repeat(np.arange(len(rows)), [len(x[i][0]) for i in rows])
            first = np.flatnonzero(np.diff(of, prepend=-1))
            pooled = np.add.reduceat(emb[ids] * weight[:, None], first)
            wrong = softmax(pooled @ w + b)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong = (wrong / len(rows)).astype(np.float32)
            back = wrong @ w.T
            w -= lr * pooled.T @ wrong
            b -= lr * wrong.sum(axis=0)
            np.subtract.at(emb, ids, (lr * len(rows)) * weight[:, None] * back[of])
    scores = (emb @ w).astype(np.float32)
    logits = np.array([x[i][1] @ scores[x[i][0]] + b for i in held])
    t = temperature_of(logits, y[held])
    p = softmax(logits / t)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    by = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[by]) >= precision * np.arange(1, len(by) + 1))
    return Model(names, scores, b, t, float(top[by[good[-1]]]) if len(good) else 1.0)


def predict(column: pa.Array, model: Model) -> np.ndarray:
    """Calibrated probabilities (texts, languages) of whole texts."""
    total, size = np.zeros((len(column), len(model.languages))), np.zeros(len(column), dtype=np.int64)
    for bucket, n in subwords(*text_buffer(column)):
        some = np.flatnonzero(n)
        if len(some):
            total[some] += np.add.reduceat(model.scores[bucket], (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
            size += n
    return softmax((total / np.maximum(size, 1)[:, None] + model.bias) / model.temperature)


def training_rows(docs: DataFrame, learn: F.Column, label: str = "lang", rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> tuple[list, list[str]]:
    """Features and labels of a ``bounded_sample`` of the rows with a label for which ``learn`` holds. Features are made on
    the executors from whole texts."""
    usable = docs.where(learn & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    picked = bounded_sample(usable, 11, rows, limit).select("o", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = counted(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("o"), part.column("label"), pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))], ["o", "label", "buckets", "counts"])

    got = map_batches(picked, run, "o long, label string, buckets array<int>, counts array<int>").toArrow().sort_by("o")
    pairs = [(np.asarray(b.values), np.asarray(c.values)) for b, c in zip(got["buckets"], got["counts"], strict=True)]
    return pairs, got["label"].to_pylist()


def identify(docs: DataFrame, learn: F.Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, lang_pred, score, accepted``, one row for each row of ``docs`` (``doc_id, text, lang``; other columns
    are ignored). The model is fitted on rows for which ``learn`` holds and which have a language. Null texts and texts
    without a letter are ``und`` with score 0; texts of any length count whole; of equal scores the first language wins; ``accepted`` tells whether the score passes the calibrated rejection.
    Repeated rows are returned repeatedly and null ids are kept, but an id is learned from once and a null id never. Without any labelled row all predictions are ``und``; an empty table gives
    no rows."""
    model = fit(*training_rows(docs, learn, rows=sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                p, known = predict(text, own), has_letter(text)
                best, score = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
                lang = [own.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known & (score >= own.threshold))], ["doc_id", "lang_pred", "score", "accepted"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(column: str = "doc_id") -> F.Column:
    """The fold that the query keeps from training."""
    return crc_of_id(column) % 3 == 1
