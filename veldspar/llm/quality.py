"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams (1 to 4) and of words and word pairs, hashed into a fixed number of
features, are scaled by the classes' log-count ratios. A linear hinge-loss model is fit to the
scaled vectors by dual coordinate descent, and its margins are turned into probabilities by a
sigmoid fit to margins of documents that the model of their fold has not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, broadcast, checkpointed, frugal, give_back, int_rows, small_batches

HALF = 18
FEATURES = 2 << HALF
BLOCK = 1 << 20
REPEATS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)


class WordHashes(dict):
    """A word's hash, kept for the next time; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = zlib.crc32(word)
        if len(word) <= 64:
            self[word] = found
        return found


class Indicators:
    """Finds the features present in whole texts. Texts are taken in overlapping blocks."""

    def __init__(self) -> None:
        self.words, self.seen = WordHashes(), np.zeros(FEATURES, bool)

    def _mark_bytes(self, text: bytes) -> None:
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        gram = np.zeros(len(b), np.uint32)
        for n in range(1, 5):
            gram = gram[: len(b) - n + 1] << np.uint32(8) | b[n - 1 :]
            if not len(gram):
                break
            self.seen[(gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - HALF)] = True

    def __call__(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        for at in range(0, len(text), BLOCK):
            self._mark_bytes(text[at : at + BLOCK + 3])
        words = text.lower().split()
        before, same = None, 0
        for at in range(0, len(words), BLOCK):
            one = np.fromiter(map(self.words.__getitem__, words[at : at + BLOCK]), np.uint32)
            chain = one if before is None else np.concatenate([before, one])
            two = chain[:-1] * np.uint32(0x85EBCA77) + chain[1:] * np.uint32(0xC2B2AE3D)
            before = one[-1:]
            same += int(np.count_nonzero(chain[:-1] == chain[1:]))
            for h in (one, two):
                self.seen[(h * np.uint32(0x9E3779B1) >> np.uint32(32 - HALF)) + np.uint32(1 << HALF)] = True
        for k, share in enumerate(REPEATS):  # pairs of one word twice, whichever word
            self.seen[FEATURES - 1 - k] = same > share * len(words)
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


@dataclass
class Model:
    """score = sigmoid(slope * margin + shift); margin = sum(weight) / norm + bias over the features present.

    norm is the root of the summed squared ratios plus ``floor``: texts with few features stay near the bias.
    """

    weight: np.ndarray
    squared: np.ndarray
    floor: float
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weight[found].sum(dtype=np.float64) / np.sqrt(self.squared[found].sum(dtype=np.float64) + self.floor)) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(FEATURES, smooth), np.full(FEATURES, smooth)]
    for row, label in zip(rows, y, strict=True):
        counts[int(label > 0)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _scaled(rows: list[np.ndarray], ratio: np.ndarray, short: float) -> tuple[list[np.ndarray], float]:
    """Each row's ratios over its norm, as views of one array that is freed as a whole, and the norms' floor."""
    ends = np.cumsum([len(r) for r in rows])
    flat = np.empty(ends[-1], np.float32)
    values = [flat[e - len(r) : e] for r, e in zip(rows, ends, strict=True)]
    small = ratio.astype(np.float32)
    for v, r in zip(values, rows, strict=True):
        np.take(small, r, out=v)
    squares = np.array([float(v @ v) for v in values])
    floor = max(1e-9, short * float(np.median(squares)))
    for v, s in zip(values, squares, strict=True):
        v /= np.float32(np.sqrt(s + floor))
    return values, floor


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 30, tolerance: float = 0.01, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine; the bias is a constant feature."""
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            projected = min(gradient, 0) if alpha[i] <= 0 else max(gradient, 0) if alpha[i] >= cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                before, alpha[i] = alpha[i], min(max(alpha[i] - gradient / square[i], 0), cost[i])
                step = (alpha[i] - before) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
        if worst < tolerance:
            break
    return w, bias


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid of least log loss, by Newton's method with smoothed targets."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, a = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, np.log((good + 1) / (bad + 1))])
    loss = lambda a: float(np.sum(np.logaddexp(0, x @ a) - target * (x @ a)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-4 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
        if np.abs(step).max() < 1e-6:
            break
    return float(a[0]), float(a[1])


def fit(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, short: float = 0.25, balance: float = 1.0, folds: int = 4) -> Model:
    """Model of the rows' features and labels (0 or 1). With one class only, every score is that class's share."""
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    good, bad = (y > 0).sum(), (y <= 0).sum()
    if not good or not bad:
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 1.0, 0.0, 0.0, float(np.log((good + 1) / (bad + 1))))
    weigh = np.where(y > 0, len(y) / (2 * good), len(y) / (2 * bad))
    costs = cost * weigh**balance

    def train(at: np.ndarray) -> Model:
        ratio = log_count_ratios([rows[i] for i in at], y[at])
        values, floor = _scaled([rows[i] for i in at], ratio, short)
        w, bias = dual_coordinate_descent([rows[i] for i in at], values, y[at], costs[at])
        return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), floor, bias, 1.0, 0.0)

    fold = np.arange(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        if len(np.unique(y[fold != k])) > 1:
            part = train(np.flatnonzero(fold != k))
            margins[fold == k] = [part.margin(rows[i]) for i in np.flatnonzero(fold == k)]
    model = train(np.arange(len(y)))
    model.slope, model.shift = _sigmoid(margins, y)
    return model


def held_out(doc_id: str = "doc_id", of: int = 4, remainder: int = 2):
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == remainder, F.lit(False))


def first_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids``, a bounded sample of doc_ids with what is known of them, with a text each: where several texts share an id, that of the lowest hash."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return texts.groupBy(*ids.columns).agg(least).select(*ids.columns, F.col("least.text").alias("text"))


def train_model(docs: DataFrame, labels: DataFrame, most: int = 4000, most_bytes: int = 512 << 20) -> Model:
    """Fit to at most ``most`` labelled documents, those of smallest hash of their id, and to ``most_bytes`` of features.

    Rows whose label, id or document is null or missing teach nothing, nor do held-out rows; an id
    with several labels counts as its lowest, one with several texts as that of the lowest hash. A
    null text teaches as an empty one, a long one by all its features (2 MB at most). Other columns
    are not read. Without labels every score is 0.5. Features are found on the executors; the driver
    gets those of the bounded sample only.
    """
    small_batches(docs.sparkSession)
    ids = (
        labels.where("doc_id is not null and quality is not null").where(~held_out())
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            found = [indicators(t).tobytes() for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    texts = first_texts(docs, ids).select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text")
    found = checkpointed(texts.mapInArrow(find, "doc_id long, label int, found binary"))
    sizes = found.select("doc_id", F.octet_length("found").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # ``most`` rows at most
    fits = np.cumsum([r.n for r in sizes]) <= most_bytes
    if not all(fits):
        found = found.where(F.col("doc_id").isin([r.doc_id for r, fit_ in zip(sizes, fits, strict=True) if fit_]))
    rows = found.toArrow().sort_by("doc_id")
    model = fit(int_rows(rows["found"]), rows["label"].to_pylist())
    del rows
    give_back()  # the driver goes on to other stages
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null text is scored as an empty one, a long one whole. Equal texts have equal scores whatever
    their ids; rows that repeat are scored each, and a null doc_id is never held out. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    held = broadcast(docs.sparkSession, model)

    @frugal
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, model = Indicators(), held()
        for batch in batches:
            scores = [model.score(indicators(batch.column(2).slice(row, 1).cast(pa.binary())[0].as_py())) for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(), F.col("text").cast("string")).mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; each row by its own text, as ``score`` has it.

    So rows that repeat go or stay together, a null text as an empty one; long ones are read whole. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    held, at = broadcast(docs.sparkSession, model), docs.columns.index("text")

    @frugal
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, model = Indicators(), held()
        for batch in batches:
            yield batch.filter(pa.array([model.score(indicators(t)) >= threshold for t in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
