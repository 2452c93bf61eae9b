"""The learned encoder: its directions against a dense decomposition, and what it finds against the hashed one."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from veldspar.operators import embedding, learned, retrieval


def dense(texts, buckets):
    """The weighted, normalised term matrix, and the rarities, by loops."""
    counts = np.zeros((len(texts), buckets))
    for row, text in enumerate(texts):
        for word in re.findall("[a-z0-9]+", (text or "").lower()):
            bucket, sign = embedding.place(word, buckets)
            counts[row, bucket] += sign
    there = (counts != 0).sum(0)
    idf = np.where(there > 0, np.log((1 + len(texts)) / (1 + there)) + 1, 0)
    a = counts * idf
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300), idf


def test_directions_are_those_of_a_dense_decomposition(spark):
    rng = random.Random(4)
    topics = [[f"w{t}x{k}" for k in range(12)] for t in range(6)]
    texts = [" ".join(rng.choices(topics[n % 6], k=20) + rng.choices([f"c{k}" for k in range(30)], k=3)) for n in range(150)] + [None, "", "!!"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    found = learned.learn(rows, dimensions=6, buckets=256, more=10, passes=4)
    a, idf = dense(texts, 256)
    assert np.allclose(found.idf, idf)
    assert np.allclose(found.columns.T @ found.columns, np.eye(6), atol=1e-8)
    _, values, right = np.linalg.svd(a)
    assert np.allclose(found.values, values[:6], rtol=1e-2)
    least = np.linalg.norm(a - a @ right[:6].T @ right[:6])
    assert np.linalg.norm(a - a @ found.columns @ found.columns.T) <= 1.02 * least
    assert np.allclose(found.embedder()(texts), a @ found.columns, atol=1e-8)
    none = learned.learn(rows.limit(0), dimensions=3, buckets=64, more=2)
    assert none.values.tolist() == [0, 0, 0] and none.embedder()(["a b"]).shape == (1, 3)


def test_it_finds_more_than_hashing_alone(spark):
    rng = random.Random(9)
    topics = [[f"t{t}w{k}" for k in range(40)] for t in range(40)]
    texts = [(n, " ".join(rng.sample(topics[n % 40], 8) + rng.choices([f"c{k}" for k in range(50)], k=12))) for n in range(800)]
    asked = [(n, " ".join(rng.sample(topics[n], 6) + rng.choices([f"c{k}" for k in range(50)], k=6))) for n in range(40)]
    corpus, questions = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "question_id long, text string")
    directions = learned.learn(corpus, dimensions=48, buckets=4096, more=16)

    def share(load):
        encode = lambda df: embedding.encoded(df, load, prefix="").drop("text")
        found = retrieval.top_k(encode(corpus), encode(questions), 10)
        return found.where(F.col("id") % 40 == F.col("question_id")).count() / 400

    plain = share(lambda: embedding.hashed_embedder(48))
    better = share(directions.load(spark))
    assert better > 0.7 and better > plain + 0.2, (better, plain)
