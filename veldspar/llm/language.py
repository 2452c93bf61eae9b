"""Language identification by string kernels.

The kernel of two texts is the share of character n-grams (lengths 1 to 3, blended) that both
have: common n-grams over the geometric mean of their numbers. Nyström landmarks map a text to its
kernel values with a few documents, whitened by the landmarks' own kernel; one-versus-rest kernel
ridge regression gives a score for each language. Texts are scored by batched matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, broadcast, checkpointed, frugal, int_rows, listed, small_batches
from .quality import first_texts, held_out

#: Places for n-grams of one, two and three letters, each a table of its own: whole n-grams are hashed to them.
PLACES = (1 << 14, 1 << 17, 1 << 20)
FIRST = (0, PLACES[0], PLACES[0] + PLACES[1])
GRAMS = sum(PLACES)
BLOCK = 1 << 20
MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _letter(code: int) -> int:
    """The lower-case letter, whatever its alphabet; 0 for what is none."""
    ch = chr(code).lower()[:1]
    return ord(ch) if ch.isalpha() else 0


def place_of(gram: list[np.ndarray], n: int) -> np.ndarray:
    """The place of each n-gram, columns of letters; one of three marks alone is no more than one mark."""
    mixed = sum((gram[k] * MIX[k] for k in range(n)), np.uint32(n) * np.uint32(0x27D4EB2F))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * MIX[0]
    return (mixed >> np.uint32(33 - PLACES[n - 1].bit_length())).astype(np.int32) + np.int32(FIRST[n - 1])


class Spectrum:
    """Finds the n-grams present in whole texts, words padded by one place. Long texts are taken in blocks."""

    def __init__(self) -> None:
        self.table = np.array([_letter(c) if not 0xD800 <= c < 0xE000 else 0 for c in range(1 << 16)], np.uint32)
        self.last = np.zeros(GRAMS, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        text, found = f" {text or ''} ", []
        for at in range(0, len(text), BLOCK):
            codes = np.frombuffer(text[at : at + BLOCK + 2].encode("utf-32-le", "replace"), np.uint32)
            c = self.table[codes & np.uint32(0xFFFF)]
            if (high := np.flatnonzero(codes >> np.uint32(16))).size:  # few texts have such letters
                known, which = np.unique(codes[high], return_inverse=True)
                c[high] = np.array([_letter(x) for x in known.tolist()], np.uint32)[which]
            places = np.concatenate([place_of([c[k : len(c) - n + 1 + k] for k in range(n)], n) for n in (1, 2, 3) if len(c) >= n])
            order = np.arange(len(places), dtype=np.int32)
            self.last[places] = order  # one of equal places stays, without a look at all the others
            found.append(places[self.last[places] == order])
        return np.sort(found[0]) if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Model:
    """scores = kernel(text, landmarks) @ weights."""

    langs: list[str]
    place: np.ndarray  # column of each n-gram among those that landmarks have, else -1
    landmarks: np.ndarray  # n-grams by landmarks, each column over the root of its number
    weights: np.ndarray

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), self.landmarks.shape[0]), np.float32)
        for k, row in enumerate(rows):
            at = self.place[row]
            x[k, at[at >= 0]] = 1 / np.sqrt(max(1, len(row)))
        return x @ self.landmarks

    def predict(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row and its share: softmax of the scores, sharpened."""
        scores = self.kernel(rows) @ self.weights
        share = np.exp(6 * (scores - scores.max(1, keepdims=True)))
        best = scores.argmax(1)
        return best, share[np.arange(len(rows)), best] / share.sum(1)


def fit(rows: list[np.ndarray], langs: list[str], landmarks: int = 192, ridge: float = 0.1) -> Model | None:
    """Model of the rows; the landmarks are the first rows, taken in turn from each language. No rows: None."""
    names = sorted(set(langs))
    if not names:
        return None
    turns = sorted(range(len(rows)), key=lambda k, n={}: (n.setdefault(langs[k], []).append(0), len(n[langs[k]]))[1])  # noqa: B006
    chosen = [rows[k] for k in turns[:landmarks]]
    used = np.unique(np.concatenate(chosen))
    place = np.full(GRAMS, -1, np.int32)
    place[used] = np.arange(len(used))
    matrix = np.zeros((len(used), len(chosen)), np.float32)
    for k, row in enumerate(chosen):
        matrix[place[row], k] = 1 / np.sqrt(max(1, len(row)))
    model = Model(names, place, matrix, np.zeros((len(chosen), len(names)), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(np.float64))
    values = np.maximum(values, 1e-6)
    whiten = vectors / np.sqrt(values)
    mapped = np.concatenate([model.kernel(rows[k : k + 256]) for k in range(0, len(rows), 256)]) @ whiten
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    weight = len(rows) / (len(names) * np.array([(np.array(langs) == x).sum() for x in langs]))[:, None]  # languages weigh alike
    model.weights = (whiten @ np.linalg.solve(mapped.T @ (weight * mapped) + ridge * np.eye(len(chosen)), mapped.T @ (weight * y))).astype(np.float32)
    return model


def train_model(docs: DataFrame, most: int = 3000, each: int = 1000, most_bytes: int = 128 << 20) -> Model | None:
    """Fit to at most ``most`` documents, at most ``each`` of a language: those of smallest hash of their id.

    Of these, as many as have ``most_bytes`` of n-grams together, which is what the driver gets.

    Held-out rows, null ids, texts or languages teach nothing; an id with several languages counts
    as its lowest, one with several texts as that of the lowest hash. Long texts are read whole. No
    rows: None.
    """
    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(of=3, remainder=1))
    learned = known.groupBy("doc_id").agg(F.min("lang").alias("learned")).withColumn("order", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    sizes = listed(learned.groupBy("learned").agg(F.count("*").alias("n")))
    # the lowest hashes of a language, about twice as many as are wanted, so that ranking never meets all of a common one
    low = learned.join(sizes, "learned").where(F.col("order") / float(1 << 63) * F.col("n") <= 2 * each + 100)
    ids = (
        low.withColumn("turn", F.row_number().over(Window.partitionBy("learned").orderBy("order", "doc_id"))).where(F.col("turn") <= each)
        .orderBy("turn", "order", "doc_id").limit(most).select("doc_id", "learned")
    )

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum()
        for batch in batches:
            found = [spectrum(t.decode("utf-8", "replace")).tobytes() for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["order", "learned", "found"])

    spectra = checkpointed(first_texts(known, ids).select(F.xxhash64("doc_id").alias("order"), "learned", "text").mapInArrow(find, "order long, learned string, found binary"))
    sizes = sorted(map(tuple, spectra.select("order", F.octet_length("found")).collect()))
    fits = np.searchsorted(np.cumsum([n for _, n in sizes]), most_bytes, "right") if sizes else 0
    if not fits:
        return None
    rows = spectra.where(F.col("order") <= sizes[fits - 1][0]).toArrow().sort_by("order")
    return fit(int_rows(rows["found"]), rows["learned"].to_pylist())


def identify(docs: DataFrame, model: Model | None, batch_rows: int = 128) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    ``und`` and score 0 where the text is null or has no letter, or where nothing was learned. Long
    texts are read whole, rows that repeat answered each; of languages that tie the first by name is
    given. Other columns are not read. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    held = broadcast(docs.sparkSession, model)

    @frugal
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, model = Spectrum(), held()
        for whole in batches:
            for begin in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(begin, batch_rows)
                rows, at = [], []
                for k in range(batch.num_rows):
                    text = batch.column(2)[k].as_py()
                    if model and text and any(map(str.isalpha, text)):
                        rows.append(spectrum(text))
                        at.append(k)
                langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
                if rows:
                    for k, best, share in zip(at, *model.predict(rows), strict=True):
                        langs[k], scores[k] = model.langs[best], float(share)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(of=3, remainder=1), F.col("text").cast("string")).mapInArrow(name, "doc_id long, held_out boolean, lang_pred string, score double")
