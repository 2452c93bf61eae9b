"""Embedding near-duplicates by a forest of random-projection trees.

A tree halves its vectors again and again: each level has a random direction, each node a
threshold, the median of a sample's projections; nodes deeper than the sample can tell apart share
their level's, its median. Vectors within a margin of the threshold spill to both sides. Trees grow
deeper with the vectors, while the model does not grow. Vectors are compared within leaves, in double precision; a pair that meets in several
leaves counts in the first of them only, so links are counted without ever listing all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, checkpointed, connected_components, frugal, listed, small_batches

SAMPLE_BYTES = 32 << 20
#: The margin of a threshold, in units of what projections of unit vectors spread by: one over the root of their dimensions.
SPILL = 0.16
TREE = 56  # a leaf's number: below this bit its node, above it its tree


@dataclass
class Forest:
    """Trees with one direction a level and one threshold a node, or a level; nodes are numbered as in a heap, from 1."""

    directions: np.ndarray  # trees, depth, dimensions
    thresholds: np.ndarray  # trees, nodes of the levels that the sample can tell apart
    level_cuts: np.ndarray  # trees, depth
    margin: float

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def projections(self, unit: np.ndarray, tree: int) -> np.ndarray:
        return unit @ self.directions[tree].T

    def leaves(self, low: np.ndarray, high: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches with all its projections, from ``low`` to ``high``, together."""
        rows, nodes = np.arange(len(low)), np.ones(len(low), np.int64)
        for level in range(self.depth):
            cut = self.thresholds[tree][nodes] if 1 << level < self.thresholds.shape[1] else self.level_cuts[tree, level]
            left, right = high[rows, level] <= cut + self.margin, low[rows, level] >= cut - self.margin
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
        return rows, nodes

    def first_meeting(self, unit: np.ndarray, a: np.ndarray, b: np.ndarray, tree: int) -> np.ndarray:
        """The lowest leaf of ``tree`` in which a[k] and b[k] meet, or 0 if they meet in an earlier tree or not at all."""
        found = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        for t in range(tree + 1):
            p = self.projections(unit, t)
            pa_, pb = p[a[left]], p[b[left]]
            rows, nodes = self.leaves(np.minimum(pa_, pb), np.maximum(pa_, pb), t)
            if t == tree:
                lowest = np.full(len(left), np.iinfo(np.int64).max)
                np.minimum.at(lowest, rows, nodes)
                met = lowest < np.iinfo(np.int64).max
                found[left[met]] = lowest[met]
            else:
                left = np.delete(left, np.unique(rows))
        return found


def plant(sample: np.ndarray, depth: int, trees: int, margin: float, known: int | None = None, seed: int = 5) -> Forest:
    """Trees fit to a sample of unit vectors: thresholds by node for ``known`` levels (or all), by level below. A node that no sampled vector reaches cuts at 0."""
    rng = np.random.default_rng(seed)
    known = depth if known is None else min(known, depth)
    d = rng.standard_normal((trees, max(depth, 0), sample.shape[1]))
    d /= np.linalg.norm(d, axis=2, keepdims=True)
    cuts, level_cuts = np.zeros((trees, 1 << known)), np.zeros((trees, depth))
    for t in range(trees):
        p, nodes = sample @ d[t].T, np.ones(len(sample), np.int64)
        if len(sample):
            level_cuts[t] = np.median(p, axis=0)
        for level in range(known):
            order = np.lexsort((p[:, level], nodes))
            groups, begins, counts = np.unique(nodes[order], return_index=True, return_counts=True)
            cuts[t, groups] = (p[order[begins + (counts - 1) // 2], level] + p[order[begins + counts // 2], level]) / 2
            nodes = 2 * nodes + (p[:, level] > cuts[t][nodes])
    return Forest(d, cuts, level_cuts, margin)


def _units(vectors: list[bytes], kind: str, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        x = np.frombuffer(v, kind)
        out[k, : len(x)] = x
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _packed(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, vec): a vector's components in a row, or null where it can link with nothing."""
    number = pa.float32() if kind == "<f4" else pa.float64()

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(1), []
            for k in range(batch.num_rows):
                values = column[k].values
                if values is None or values.null_count or not len(values):
                    out.append(None)
                    continue
                x = values.cast(number).to_numpy().astype(kind) + np.array(0, kind)  # -0 becomes 0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(pack, "vec_id long, vec binary")


Counts = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _compare_leaf(keys: np.ndarray, weights: np.ndarray, unit: np.ndarray, counts_here: Counts, least: float, split: int | None = None, block: int = 1024) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each vector that count in this leaf, and links that span what is connected in it.

    ``counts_here`` tells of pairs (unit vectors, places of either) whether this is the leaf that counts them.
    With ``split``, the vectors before it are compared with those from it on, and with no others.
    """
    counts, parent, spans = np.zeros(len(keys), np.int64), np.arange(len(keys)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    end = len(keys) if split is None else split
    for i in range(0, end, block):
        for j in range(i if split is None else split, len(keys), block):
            a, b = np.nonzero(unit[i : min(i + block, end)] @ unit[j : j + block].T >= least)
            a, b = a + i, b + j
            a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                rows, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                here = counts_here(unit[rows], place[: len(x)], place[len(x) :])
                np.add.at(counts, x[here], weights[y[here]])
                np.add.at(counts, y[here], weights[x[here]])
            if len(a):
                label = np.array([root(k) for k in range(len(keys))])
                far = np.flatnonzero(label[a] != label[b])
                for k in far.tolist():
                    x, y = root(a[k]), root(b[k])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        spans.append((int(keys[a[k]]), int(keys[b[k]])))
    return counts, spans


def near_duplicates(vectors: DataFrame, least: float = 0.95, trees: int = 6, leaf: int = 250, spill: float = SPILL, crowded: int = 20_000, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are
    their own component; shorter vectors count as padded with zeros. Equal vectors are compared as
    one, with their number as weight. A row whose vec_id is null takes no part: no links, a null
    component, not kept. Rows that share a vec_id are separate vectors. No rows: no rows.

    The forest is fit to a sample of at most ``sample_bytes``, so its size is bounded too; every vector
    is indexed. Projections spread less the more dimensions there are, and the margin, ``spill`` over
    their root, with them, so that a vector reaches about as many leaves whatever its dimensions. Its depth grows with the vectors, ``leaf`` to a leaf on average. A leaf of at most
    ``crowded`` vectors is held by one task. A larger one, a crowd of vectors too much alike, is cut
    into blocks of about a quarter of that, and each pair of blocks is a task's work of its own, so
    every pair of a leaf is compared whatever its size; a vector is then sent once for each block of its leaf.
    """
    small_batches(vectors.sparkSession)
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = _packed(vectors, kind)
    grouped = rows.where("vec is not null and vec_id is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    distinct = checkpointed(grouped.withColumn("key", F.monotonically_increasing_id()))
    n, longest = distinct.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    dims = max(1, (longest or 0) // int(kind[2]))
    margin = spill / dims**0.5
    most = max(1, min(1 << 15, sample_bytes // (8 * dims)))
    sample = distinct.orderBy(F.xxhash64("vec"), "key").limit(most).select("vec").toArrow()["vec"].to_pylist()
    depth = int(max(0, np.ceil(np.log2(max(1, n / leaf)))))
    known = int(max(0, np.log2(max(1, len(sample) / 16))))
    forest_of = broadcast(vectors.sparkSession, plant(_units(sample, kind, dims), depth, trees if depth else 1, margin, known))

    @frugal
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = forest_of()
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                unit = _units(part.column(1).to_pylist(), kind, dims)
                for tree in range(len(forest.directions)):
                    p = forest.projections(unit, tree)
                    at, leaves = forest.leaves(p, p, tree)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves | (tree << TREE)), part.column(0).take(pa.array(at))], ["leaf", "key"])

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = forest_of()
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                unit = _units(part.column(2).to_pylist(), kind, dims)
                for tree in range(len(forest.directions)):
                    p = forest.projections(unit, tree)
                    at, leaves = forest.leaves(p, p, tree)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves | (tree << TREE)), *(c.take(pa.array(at)) for c in part.columns)], ["leaf", "key", "weight", "vec"])

    dealt = distinct.select("key", "weight", "vec").mapInArrow(deal, "leaf long, key long, weight long, vec binary").withColumn("n", F.lit(0)).withColumn("pair", F.lit(0))
    if n > crowded:
        counts = distinct.select("key", "vec").mapInArrow(reach, "leaf long, key long").groupBy("leaf").count().where(F.col("count") > crowded)
        crowds = listed(counts.select(F.col("leaf").alias("crowd"), F.ceil(F.col("count") / max(1, crowded // 4)).cast("int").alias("blocks")))
        own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        met = dealt.drop("n", "pair").join(crowds, dealt["leaf"] == crowds["crowd"], "left").withColumns({"n": F.coalesce("blocks", F.lit(0)), "own": F.coalesce(own, F.lit(0))})
        others = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(0)))
        dealt = met.select("leaf", "key", "weight", "vec", "n", "own", F.explode(others).alias("other"))
        dealt = dealt.withColumn("pair", F.least("own", "other") * F.col("n") + F.greatest("own", "other"))
    else:
        dealt = dealt.withColumn("own", F.lit(0))
    dealt = dealt.select("leaf", "pair", "own", "n", "key", "weight", "vec")

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, group_at = forest_of(), [], None

        def found() -> pa.RecordBatch:
            leaf_at, pair = group_at
            own, blocks, keys, weights, vecs = (pa.chunked_array([b.column(c) for b in held]) for c in (2, 3, 4, 5, 6))
            own, n, keys, weights, unit = own.to_numpy(), blocks[0].as_py(), keys.to_numpy(), weights.to_numpy(), _units(vecs.to_pylist(), kind, dims)
            # rows are in order of their block: those of the lower one come first
            split = int((own == pair // n).sum()) if n and pair // n != pair % n else None
            first = lambda u, a, b: forest.first_meeting(u, a, b, leaf_at >> TREE) == leaf_at & ((1 << TREE) - 1)
            counts, spans = _compare_leaf(keys, weights, unit, first, least, split)
            some = np.flatnonzero(counts)
            u, v = keys[some].tolist() + [s[0] for s in spans], [None] * len(some) + [s[1] for s in spans]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(counts[some].tolist() + [0] * len(spans), pa.int64())], ["u", "v", "n"])

        for batch in batches:
            leaves, pairs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(leaves) != 0) | (np.diff(pairs) != 0)) + 1).tolist(), len(leaves)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and group_at != (leaves[a], pairs[a]):
                    yield found()
                    held = []
                group_at = (int(leaves[a]), int(pairs[a]))
                held.append(batch.slice(a, b - a))
        if held:
            yield found()

    ordered = dealt.repartition("leaf", "pair").sortWithinPartitions("leaf", "pair", "own", "key")
    pairs = checkpointed(ordered.mapInArrow(compare, "u long, v long, n long"))
    counts = pairs.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    parts = connected_components(pairs.where("v is not null").select("u", "v")).withColumnRenamed("node", "key")
    placed = distinct.join(counts, "key", "left").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(lowest, "component").select("vec", F.col("weight") - 1 + F.coalesce("n", F.lit(0)), "component_id").toDF("vec", "n_links", "component_id")
    joined = rows.join(known, (rows["vec"] == known["vec"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
