"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words, and their shapes (runs of lower-case, upper-case, other letters, digits and each mark), are hashed to slots. A
slot's index vector is sparse and ternary, from a hash. Its context vector sums the index vectors of the slots beside it
in every document, which is random indexing: each task adds up a table of fixed size, and the tables are added up by slot.
A document is the mean of its words' and of its shapes' normalised context vectors, words weighted down by how frequent
their slots are in the corpus. A network of one hidden layer (ReLU) and one output is trained with Adam on a bounded
sample of labelled documents; its probabilities are calibrated by a temperature on rows kept from the training.

The first layer is linear in the pooled vectors, so scoring a document is a mean over rows of a (slot, hidden) table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_sample, crc_of_id, free_name, hash_bound, map_batches, quoted, slices, text_buffer, with_column

SLOTS, DIM, NONZERO, WINDOW, HIDDEN = 1 << 15, 64, 6, 2, 24
#: Labelled documents that the network is fitted on at most, and their text bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 16 << 20
#: Pairs of neighbouring slots that are added up at once.
PAIRS = 1 << 16
#: Weight of a word slot: FREQUENT / (FREQUENT + its share of the corpus).
FREQUENT = 1e-3
KEEP = 0.3

_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_shape = np.arange(256, dtype=np.uint8)
_shape[0x61:0x7B], _shape[0x41:0x5B], _shape[0x30:0x3A], _shape[0x80:] = ord("a"), ord("A"), ord("0"), ord("a")


class Corpus(NamedTuple):
    """What all documents say of the slots."""

    vectors: np.ndarray  # (2 * SLOTS, DIM): unit context vectors, zero for slots that don't occur
    weight: np.ndarray  # of each slot in a document's mean


class Network(NamedTuple):
    mean: np.ndarray  # of the pooled vectors, which are centred and scaled
    scale: np.ndarray
    first: np.ndarray  # (2 * DIM, HIDDEN)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float


class Model(NamedTuple):
    """A network with its first layer multiplied by the vectors."""

    table: np.ndarray  # (2 * SLOTS, HIDDEN): what a word slot, then a shape slot, adds to the hidden layer
    weight: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float


def _hashed(codes: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """Slot of each run of bytes that starts at ``first``: a polynomial hash, modulo 2 ** 64."""
    if not len(first):
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    with np.errstate(over="ignore"):
        value = np.add.reduceat((codes.astype(np.uint64) + np.uint64(salt)) * _powers(int(place.max()) + 1)[place], first)
        value ^= value >> np.uint64(31)
        value *= np.uint64(0x9E3779B97F4A7C15)
    return (value >> np.uint64(49)).astype(np.int64)


def _powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)


def slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slot and shape slot (from SLOTS on) of each word of all texts, and how many words each text has."""
    data, offsets = text_buffer(column)
    own = data[: offsets[-1]]
    solid = ~_space[own]
    start = np.zeros(len(own), dtype=bool)
    if len(own):
        start[0] = solid[0]
        start[1:] = solid[1:] & ~solid[:-1]
        at = offsets[:-1][np.diff(offsets) > 0]
        start[at] = solid[at]
    per = np.diff(np.concatenate([[0], np.cumsum(start, dtype=np.int64)])[offsets])
    kept = np.flatnonzero(solid)
    first = np.flatnonzero(start[kept])
    words = _hashed(own[kept], first, 1)
    kind = _shape[own[kept]]
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | start[kept[1:]]
    runs = np.flatnonzero(new)
    shapes = _hashed(kind[runs], np.flatnonzero(start[kept[runs]]), 2)
    return words, shapes + SLOTS, per


def index_vectors(seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each slot's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (2 * SLOTS, NONZERO), dtype=np.int32), rng.choice(np.array([-1, 1], dtype=np.int32), (2 * SLOTS, NONZERO))


def add_contexts(sums: np.ndarray, flat: np.ndarray, of: np.ndarray, seed: int = 42) -> None:
    """Add to each slot's row of ``sums`` the index vectors of the slots beside its occurrences in ``flat``, the slots of
    texts in turn; ``of`` numbers the texts."""
    place, sign = _indices(seed)
    total, keys = sums.reshape(-1), []
    for gap in range(1, WINDOW + 1):
        near = of[:-gap] == of[gap:]
        keys.append(flat[:-gap][near] * (2 * SLOTS) + flat[gap:][near])
    # Each distinct pair of neighbours once, times how often it occurs.
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(first, len(key))).astype(np.int32)[:, None]
    one, two = np.divmod(key[first], 2 * SLOTS)
    for x, y in ((one, two), (two, one)):
        for k in range(0, len(x), PAIRS):
            part = slice(k, k + PAIRS)
            np.add.at(total, (x[part, None] * DIM + place[y[part]]).ravel(), (sign[y[part]] * times[part]).ravel())


_made: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _indices(seed: int) -> tuple[np.ndarray, np.ndarray]:
    if seed not in _made:
        _made[seed] = index_vectors(seed)
    return _made[seed]


def corpus_of(slot: np.ndarray, n: np.ndarray, sums: np.ndarray) -> Corpus:
    """Unit vectors and weights from the sums and counts of the slots that occur."""
    vectors, weight = np.zeros((2 * SLOTS, DIM), np.float32), np.zeros(2 * SLOTS, np.float32)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors[slot] = sums / np.where(norm > 0, norm, 1)
    words = slot < SLOTS
    share = n / max(1, int(n[words].sum()))
    weight[slot] = np.where(words, FREQUENT / (FREQUENT + share), 1)  # shapes are few and telling
    return Corpus(vectors, weight)


def corpus_statistics(docs: DataFrame) -> Corpus:
    """Context vectors and slot counts over the whole texts of all rows of ``docs``. A task keeps one table of ``2 * SLOTS``
    rows and sends those in use; they are added up by slot, and the driver gets one row for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((2 * SLOTS, DIM), np.int32), np.zeros(2 * SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, shapes, per = slots(part.column("text"))
                of = np.repeat(np.arange(len(per)), per)
                for flat in (words, shapes):
                    add_contexts(sums, flat, of)
                    counts += np.bincount(flat, minlength=2 * SLOTS)
        used = np.flatnonzero(counts)
        for k in range(0, len(used), 4096):
            at = used[k : k + 4096]
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * DIM)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.ListArray.from_arrays(ends, pa.array(sums[at].reshape(-1)))], ["slot", "n", "v"])

    parts = map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "slot int, n long, v array<int>")
    total = parts.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("v")[k]).cast("float") for k in range(DIM)]).alias("v"))
    got = total.toArrow().combine_chunks()
    sums = got["v"].combine_chunks().flatten().to_numpy().reshape(-1, DIM) if len(got) else np.zeros((0, DIM))
    return corpus_of(got["slot"].to_numpy(), got["n"].to_numpy(), sums)


def pooled(words: np.ndarray, shapes: np.ndarray, corpus: Corpus) -> np.ndarray:
    """The features of a document: weighted means of its words' and of its shapes' vectors, zeros without any."""
    mean = lambda part, w: (w[:, None] * corpus.vectors[part]).sum(axis=0) / max(float(w.sum()), 1e-9)
    return np.concatenate([mean(part, corpus.weight[part]) for part in (words, shapes)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, labels: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 42) -> Network:
    """Train on features of documents and 0/1 labels. Every sixth row calibrates only."""
    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, dtype=np.float64).reshape(len(labels), 2 * DIM), np.asarray(labels, dtype=np.float64)
    order = rng.permutation(len(x))
    held, train = (order[::6], np.setdiff1d(order, order[::6])) if len(x) >= 60 else (order, order)
    scale = x[train].std(axis=0) + 1e-3 if len(train) else np.ones(x.shape[1])
    mean = x[train].mean(axis=0) if len(train) else np.zeros(x.shape[1])
    z = (x - mean) / scale
    share = float(np.clip(y[train].mean() if len(train) else 0.5, 1e-3, 1 - 1e-3))
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.array(np.log(share / (1 - share)))]
    if not len(train):
        p[2], p[3] = np.zeros(HIDDEN), np.array(0.0)
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs if len(train) else 0):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            wrong = (_sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
            back = np.outer(wrong, p[2]) * (h > 0)
            grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ wrong + decay * p[2], wrong.sum()]
            t += 1
            step = rate * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    temperature = 1.0
    if len(held):
        logits, target = np.maximum(z[held] @ p[0] + p[1], 0) @ p[2] + p[3], y[held]
        soft = target * (1 - 2 / (len(held) + 4)) + 1 / (len(held) + 4)  # one pseudo-row of each kind or so
        grid = np.geomspace(0.2, 20, 200)
        loss = [-(soft * np.log(_sigmoid(logits / g)) + (1 - soft) * np.log(_sigmoid(-logits / g))).mean() for g in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Network(mean, scale, p[0], p[1], p[2], float(p[3]), temperature)


def fold(network: Network, corpus: Corpus) -> Model:
    first = network.first / network.scale[:, None]
    table = np.concatenate([corpus.vectors[:SLOTS] @ first[:DIM], corpus.vectors[SLOTS:] @ first[DIM:]])
    return Model((table * corpus.weight[:, None]).astype(np.float32), corpus.weight, network.bias - network.mean @ first, network.out, network.out_bias, network.temperature)


def score(column: pa.Array, model: Model) -> np.ndarray:
    """Calibrated probabilities of label 1 for whole texts; null counts as empty."""
    words, shapes, per = slots(column)
    hidden = np.tile(model.bias, (len(per), 1))
    some = np.flatnonzero(per)
    if len(some):
        first = (np.cumsum(per) - per)[some]
        for part in (words, shapes):
            total = np.add.reduceat(model.weight[part], first, dtype=np.float64)
            hidden[some] += np.add.reduceat(model.table[part], first, axis=0, dtype=np.float64) / np.maximum(total, 1e-9)[:, None]
    return _sigmoid((np.maximum(hidden, 0) @ model.out + model.out_bias) / model.temperature)


def training_rows(docs: DataFrame, labels: DataFrame, learn: F.Column, corpus: Corpus, label: str = "quality", rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a ``bounded_sample`` of the labelled documents for which ``learn`` holds. Labels are chosen
    first, by the same hash of the id, so that only their documents are read out; features are made on the executors."""
    own = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64("doc_id", F.lit(13))
    near = own.where(order <= hash_bound(2 * rows / max(own.count(), 1))).orderBy(order).limit(2 * rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = bounded_sample(texts.join(F.broadcast(near), "doc_id"), 13, rows, limit, few=True).select("o", "label", "text")
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, shapes, per = slots(part.column("text"))
                ends = np.concatenate([[0], np.cumsum(per)])
                x = [pooled(words[a:b], shapes[a:b], shared.value) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("o"), part.column("label"), pa.array(x, pa.list_(pa.float32()))], ["o", "label", "x"])

    got = map_batches(picked, run, "o long, label int, x array<float>").toArrow().sort_by("o")
    return np.array(got["x"].to_pylist(), dtype=np.float32).reshape(-1, 2 * DIM), got["label"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, label: str = "quality") -> Model:
    corpus = corpus_statistics(docs)
    return fold(fit(*training_rows(docs, labels, learn, corpus, label)), corpus)


def with_score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS rows of HIDDEN numbers, twice
    return with_column(docs, text, name, T.DoubleType(), lambda column: pa.array(score(column, shared.value), pa.float64()))


def learned(column: str = "doc_id") -> F.Column:
    """The folds that the query learns from."""
    return crc_of_id(column) % 5 != 0


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs`` (``doc_id, text``; other columns are ignored). Vectors
    are of all texts, the network of at most ``SAMPLE_ROWS`` labelled ones.
    Labels are ``doc_id, quality``; null labels and ids are left out, a repeated id has its smallest label. Null and
    empty texts have the score of a text without words. Repeated rows are returned repeatedly. Without labels every
    score is the same; an empty table gives no rows."""
    model = train(docs, labels, learned())
    rows = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", F.coalesce(~learned(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Rows of ``docs`` with a score of ``keep`` or more, with their columns, whatever other columns are called. Nulls,
    empty texts, repeated rows, labels and empty tables as in ``classify``; texts of any length count whole."""
    name = free_name(docs, "__score")
    return with_score(docs, train(docs, labels, learned()), name).where(F.col(name) >= keep).select(*quoted(docs.columns))
