"""Texts as vectors, and vectors as points.

An Embedder turns a list of texts into a matrix. The default needs no model: signed hashed counts
of words, in whole numbers, so that any engine gets the same. It keeps the operator's contract, not
a neural model's sense of meaning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

Embedder = Callable[[list[str]], np.ndarray]

WORDS = r"[^a-z0-9]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def hashed_terms(texts: DataFrame, key: str, dimensions: int = 768) -> DataFrame:
    """(key, bucket, weight): signed counts of a text's words by bucket, zeros left out (E2, sparse)."""
    word = texts.select(key, F.explode(words(F.col("text"))).alias("w")).withColumn("h", F.md5("w"))
    bucket = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % dimensions
    sign = F.when(F.conv(F.substring("h", 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return word.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign).alias("weight")).where("weight <> 0")


def place(word: str, dimensions: int) -> tuple[int, int]:
    """(bucket, sign) of a word."""
    digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dimensions, 1 - 2 * (int(digest[8], 16) % 2)


class Places(dict):
    """The places of words seen before; emptied when full."""

    def __init__(self, dimensions: int, most: int = 200_000):
        self.dimensions, self.most = dimensions, most

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = place(word, self.dimensions)
        return found


def hashed_embedder(dimensions: int = 768) -> Embedder:
    """The default: not normalised, whole numbers."""
    import re

    split, places = re.compile(WORDS).split, Places(dimensions)

    def embed(texts: list[str]) -> np.ndarray:
        at: list[int] = []
        signs: list[int] = []
        for row, text in enumerate(texts):
            for word in filter(None, split((text or "").lower())):
                bucket, sign = places[word]
                at.append(row * dimensions + bucket)
                signs.append(sign)
        return np.bincount(np.array(at, np.int64), np.array(signs, float), len(texts) * dimensions).reshape(len(texts), dimensions)

    return embed


def sentence_transformer(name: str) -> Callable[[], Embedder]:
    """A neural embedder, where its library is installed; loaded once a task."""

    def load() -> Embedder:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        return lambda texts: np.asarray(model.encode(texts, normalize_embeddings=True))

    return load


def encoded(texts: DataFrame, load: Callable[[], Embedder] = hashed_embedder, prefix: str = "passage: ", normalise: bool = True, text: str = "text", into: str = "vector", most: int = 512) -> DataFrame:
    """``texts`` with the vector of the prefixed text behind the other columns (E1 to E3); a null text is empty. ``most`` texts are a matrix at a time."""
    at = texts.columns.index(text)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in (whole.slice(k, most) for whole in batches for k in range(0, whole.num_rows, most)):
            matrix = model([prefix + (t or "") for t in batch.column(at).to_pylist()])
            if normalise:
                matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
            flat = pa.array(matrix.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32), flat)], [*batch.schema.names, into])

    return texts.mapInArrow(embed, StructType([*texts.schema.fields, StructField(into, ArrayType(FloatType()))]))


def normalised(vector: Column) -> Column:
    """Over its Euclidean norm, in double; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def points(chunks: DataFrame, source_file: Column | None = None, prefix: str = "passage: ") -> DataFrame:
    """(doc_id, id, vector, payload) of encoded chunks (E4); id is the chunk's place in its document, the source ``unknown`` where it is not known (E5)."""
    source = F.coalesce(source_file if source_file is not None else F.lit(None).cast("string"), F.lit("unknown"))
    payload = F.struct(F.concat(F.lit(prefix), "text").alias("text"), source.alias("source_file"), F.col("chunk_index").cast("int").alias("chunk_index"))
    return chunks.select("doc_id", F.col("chunk_index").cast("bigint").alias("id"), "vector", payload.alias("payload"))
