"""An encoder that is learned from the corpus: latent semantic directions of weighted terms.

A text is a sparse vector of hashed word counts, each count times the logarithm of how rare its
bucket is among the texts. The directions in which these vectors lie most are found by a truncated
singular value decomposition: a random test matrix is drawn through the corpus a few times (a
randomised range finder with power iterations), every pass being one scan whose partial products
are summed in a tree of tasks. The driver holds matrices of ``buckets`` by a few dozen numbers,
however many texts there are.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import WORDS, Embedder, Places, hashed_terms


def rarity(terms: DataFrame, n_texts: int) -> DataFrame:
    """(bucket, idf) of terms (key, bucket, weight): log((1 + texts) / (1 + texts that have the bucket)) + 1."""
    return terms.groupBy("bucket").agg((F.log((F.lit(1.0) + n_texts) / (1.0 + F.count("*"))) + 1.0).alias("idf"))


def weighted_terms(texts: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key, bucket, weight): signed counts of hashed words (as of ``hashed_terms``) times their rarity among ``texts`` (key, text)."""
    terms = hashed_terms(texts, key, buckets)
    return terms.join(rarity(terms, texts.count()), "bucket").select(key, "bucket", (F.col("weight") * F.col("idf")).alias("weight"))


@dataclass(frozen=True)
class Sparse:
    """Texts as sparse unit vectors: of row r the places ``at[begin[r]:begin[r + 1]]`` and their ``values``."""

    begin: np.ndarray
    at: np.ndarray
    values: np.ndarray

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The product with a matrix of a row for each bucket."""
        out = np.zeros((len(self.begin) - 1, matrix.shape[1]))
        np.add.at(out, np.repeat(np.arange(len(out)), np.diff(self.begin)), self.values[:, None] * matrix[self.at])
        return out

    def transposed_times(self, matrix: np.ndarray, buckets: int) -> np.ndarray:
        out = np.zeros((buckets, matrix.shape[1]))
        np.add.at(out, self.at, self.values[:, None] * matrix[np.repeat(np.arange(len(matrix)), np.diff(self.begin))])
        return out


def sparse(texts: list[str | None], idf: np.ndarray, places: Places, split: Callable) -> Sparse:
    begin, at, values = [0], [], []
    for text in texts:
        counts: dict[int, int] = {}
        for word in filter(None, split((text or "").lower())):
            bucket, sign = places[word]
            counts[bucket] = counts.get(bucket, 0) + sign
        row = {b: n * idf[b] for b, n in counts.items() if n}
        norm = sum(v * v for v in row.values()) ** 0.5 or 1.0
        at += row
        values += [v / norm for v in row.values()]
        begin.append(len(at))
    return Sparse(np.array(begin), np.array(at, np.int64), np.array(values, np.float64))


def _summed(texts: DataFrame, part: Callable[[list], np.ndarray], shape: tuple[int, int], fan: int = 16) -> np.ndarray:
    """The sum over all texts of ``part``, a matrix for each batch: added up within tasks, then by ``fan`` at a time over as many rounds as it takes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for row in range(batch.num_rows):
                total += np.frombuffer(batch.column(0)[row].as_buffer(), np.float64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    sums = texts.select("text").mapInArrow(add, "m binary")
    tasks = texts.rdd.getNumPartitions()
    while tasks > fan:
        tasks = -(-tasks // fan)
        sums = sums.repartition(tasks).mapInArrow(merge, "m binary")
    return sum((np.frombuffer(r["m"], np.float64).reshape(shape) for r in sums.toLocalIterator()), np.zeros(shape))


@dataclass(frozen=True)
class Directions:
    """What was learned: orthonormal columns by bucket, the singular value of each, and how rare each bucket is."""

    columns: np.ndarray  # buckets, dimensions
    values: np.ndarray
    idf: np.ndarray

    def embedder(self) -> Embedder:
        split, places = re.compile(WORDS).split, Places(len(self.idf))
        return lambda texts: sparse(texts, self.idf, places, split).times(self.columns)

    def load(self, spark: object) -> Callable[[], Embedder]:
        """For ``encoded``: sent once to each executor; its size is that of the parameters."""
        sent = spark.sparkContext.broadcast(pickle.dumps(self))
        return lambda: pickle.loads(sent.value).embedder()  # noqa: S301  sent by this driver


def learn(texts: DataFrame, dimensions: int = 64, buckets: int = 1 << 14, more: int = 16, passes: int = 3, seed: int = 7) -> Directions:
    """The ``dimensions`` directions of most weight among ``texts`` (text); ``more`` are looked for beside them, in ``passes`` scans.

    Null and empty texts weigh nothing; long ones are read whole; texts that repeat count as often. Of
    texts that have fewer directions, as of none, the rest of the columns have the value 0. Each scan sums a matrix of
    ``buckets`` rows and ``dimensions + more`` columns.
    """
    if dimensions + more > buckets:
        raise ValueError("more directions than buckets")
    keyed = texts.select(F.monotonically_increasing_id().alias("k"), "text")
    terms = hashed_terms(keyed, "k", buckets)
    idf = np.zeros(buckets)
    for bucket, value in rarity(terms, texts.count()).toLocalIterator():
        idf[bucket] = value
    width, split = dimensions + more, re.compile(WORDS)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width)))[0]
    for step in range(passes):
        sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps((idf, basis)))

        def through(rows: list, sent=sent) -> np.ndarray:  # noqa: ANN001
            idf, basis = pickle.loads(sent.value)  # noqa: S301  sent by this driver
            a = sparse(rows, idf, Places(buckets), split.split)
            return a.transposed_times(a.times(basis), buckets)

        image = _summed(texts, through, (buckets, width))
        if step < passes - 1:
            basis = np.linalg.qr(image)[0]
    inner = basis.T @ image  # of the corpus within the basis
    weights, turned = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-weights)[:dimensions]
    return Directions(basis @ turned[:, order], np.sqrt(np.maximum(weights[order], 0.0)), idf)
