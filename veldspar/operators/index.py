"""An exact index for corpus-wide search: points stored by cluster, left out by the triangle inequality.

On the unit sphere the distance of two vectors is sqrt(2 - 2 cosine), a metric, so the nearest by it are
the nearest by cosine. Each point lies in the cluster of its nearest pivot, and a cluster is cut by
distance to its pivot into blocks of a bounded number of points. A search runs over all questions at
once. Each question first meets the block where it would lie itself; the k-th best score there bounds
how far its answers can be. Clusters and blocks that the bound and the distances to pivots rule out
are never compared with it, and those that are ruled out for all questions are not read.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.slices import small_batches
from ..sources.files import written
from .retrieval import MOST_ASKED, Best, _units

#: Scores are rounded to six places, and ties go to the smaller id: what might round to the k-th best is no farther than this beyond it.
SLACK = 1e-6
#: Rounding of distances.
BLUR = 1e-9


def centres(vectors: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``n`` pivots at most among unit vectors: spread out first, then moved to the middle of what is nearest to each."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(vectors)))]
    gap = 1 - vectors @ vectors[chosen[0]]
    while len(chosen) < n and gap.max() > 1e-12:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, 1 - vectors @ vectors[chosen[-1]])
    pivots = vectors[chosen]
    for _ in range(rounds):
        nearest = (vectors @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), pivots)
    return pivots


def distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * units @ pivots.T))


def _keys(cluster: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places along the clusters and, within one, by distance; copies of a vector, whose distances differ by rounding, share one."""
    return np.round(4 * cluster + far, 6)


def _routes(unit: np.ndarray, least: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clusters that each question may have hits in, its distances to their pivots, how far its hits can be); least: the k-th best score so far, or -1."""
    radius = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(-1.0, least - SLACK))) + BLUR
    far = distances(unit, pivots)
    home = np.where(there, far, np.inf).min(1, keepdims=True)
    # a point of another cluster is nearer to that pivot than to home's, and lies within its cluster's distances
    return there & ((far - home) / 2 <= radius[:, None]) & (far - radius[:, None] <= high + BLUR) & (far + radius[:, None] >= low - BLUR), far, radius


class Index:
    """An index in a folder that all executors reach: ``points`` by cluster, ``clusters`` and ``blocks`` with what they hold.

    Pivots are the only part that each task gets whole: ``pivots`` vectors at most, however many points there are.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = json.loads(spark.read.text(f"{self.folder}/about").first()[0])
        self.dimensions, self.ids, self.kind = about["dimensions"], tuple(about["ids"]), about["kind"]
        rows = sorted(spark.read.parquet(f"{self.folder}/clusters").collect())
        self.pivots = np.array([r["pivot"] for r in rows], np.float64).reshape(len(rows), self.dimensions)
        self.low, self.high, self.n = (np.array([r[c] for r in rows]) for c in ("low", "high", "n"))

    @classmethod
    def build(cls, points: DataFrame, folder: str, ids: tuple[str, ...] = ("id",), dimensions: int | None = None, pivots: int = 256, sample: int = 8192, block: int = 1024) -> Index:
        """Writes the index of ``points`` (``ids``, whole numbers, and vector) into a new folder.

        Vectors of another length than ``dimensions`` (by default that of the first of the sample),
        with parts that are no finite numbers, or of length zero are no point's, as in ``top_k``. Pivots
        are found on ``sample`` vectors, the first by a hash; all points are indexed. Points of one
        cluster lie in several tasks where they are many: the sample tells which go to a task, so each
        point is placed once and moved once. No points make an empty index.
        """
        spark = points.sparkSession
        small_batches(spark)
        rows = points.select(*[F.col(i).cast("bigint").alias(i) for i in ids], "vector").where("vector is not null")
        by_hash = rows.withColumn("_h", F.xxhash64(*ids))
        # found on the ids alone, so that no task sorts or holds vectors that are not of the sample
        bound = by_hash.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
        some = by_hash.where(F.col("_h") <= F.lit(bound).cast("bigint")).orderBy("_h", *ids).limit(sample).select("vector").toArrow()["vector"].combine_chunks()
        if dimensions is None:
            dimensions = len(some[0]) if len(some) else 0
        units = _units(some, dimensions)[1] if len(some) and dimensions else np.zeros((0, dimensions))
        chosen = centres(units, min(pivots, max(1, int(len(units) ** 0.5) * 2))) if len(units) else np.zeros((0, dimensions))
        if not len(chosen) and dimensions:  # the sample holds no point; one pivot will do
            chosen = np.eye(1, dimensions)
        width, tasks = len(ids), int(spark.conf.get("spark.sql.shuffle.partitions"))
        if len(units):
            far = distances(units, chosen)
            cuts = np.sort(_keys(far.argmin(1), far.min(1)))[np.arange(1, tasks) * len(units) // tasks]
        else:
            cuts = np.linspace(0, 2, tasks + 1)[1:-1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):  # no matrix is as large as a batch
                at, wide = _units(batch.column(width), dimensions) if dimensions else (np.zeros(0, int), np.zeros((0, 0)))
                if not len(at):
                    continue
                far = distances(wide, chosen)
                cluster = far.argmin(1)
                kept = [batch.column(c).take(pa.array(at)) for c in range(width)]
                near = far[np.arange(len(at)), cluster]
                key = _keys(cluster, near)
                first, last = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
                mixed = np.zeros(len(at), np.uint64)  # a crowd at one place is dealt by its ids to the tasks that share it
                for i in kept:
                    mixed = (mixed ^ i.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                part = first + (mixed >> np.uint64(33)).astype(np.int64) % (last - first + 1)
                yield pa.RecordBatch.from_arrays([*kept, batch.column(width).take(pa.array(at)), pa.array(cluster, pa.int32()), pa.array(near), pa.array(part, pa.int32())], [*ids, "vector", "cluster", "distance", "part"])

        kind = dict(rows.dtypes)["vector"]
        schema = ", ".join([*(f"{i} bigint" for i in ids), f"vector {kind}", "cluster int", "distance double", "part int"])
        placed = rows.mapInArrow(place, schema)
        cut = placed.repartitionById(tasks, "part").drop("part").sortWithinPartitions("cluster", "distance", *ids).withColumn("block", F.floor(F.monotonically_increasing_id() / block))
        cut.write.partitionBy("cluster").parquet(f"{folder}/points")
        there = cls._read(spark, folder, ids, kind)
        there.groupBy("cluster", "block").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.min(F.struct(*ids)).alias("first")).write.parquet(f"{folder}/blocks")
        held = {r["cluster"]: r for r in spark.read.parquet(f"{folder}/blocks").groupBy("cluster").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        clusters = [(c, p.tolist(), *((held[c]["low"], held[c]["high"], held[c]["n"]) if c in held else (0.0, -1.0, 0))) for c, p in enumerate(chosen)]
        spark.createDataFrame(clusters, "cluster int, pivot array<double>, low double, high double, n long").coalesce(1).write.parquet(f"{folder}/clusters")
        spark.createDataFrame([(json.dumps({"dimensions": dimensions, "ids": ids, "kind": kind}),)], "value string").coalesce(1).write.text(f"{folder}/about")  # last: an index without it is none
        return cls(spark, folder)

    @staticmethod
    def _read(spark: SparkSession, folder: str, ids: tuple[str, ...], kind: str) -> DataFrame:
        schema = ", ".join([*(f"{i} bigint" for i in ids), f"vector {kind}", "distance double", "block bigint", "cluster int"])
        return spark.read.schema(schema).parquet(f"{folder}/points")

    def _asked(self, questions: DataFrame) -> DataFrame:
        """(question_id, unit, home cluster, distance to its pivot) of the questions that can have hits."""
        kind, dimensions, pivots, there = dict(questions.dtypes)["question_id"], self.dimensions, self.pivots, self.n > 0

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, wide = _units(batch.column(1), dimensions)
                if len(at):
                    far = np.where(there, distances(wide, pivots), np.inf)
                    home = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(home, pa.int32()), pa.array(far[np.arange(len(at)), home])], ["question_id", "asked", "cluster", "far"])

        return questions.select("question_id", "vector").mapInArrow(ask, f"question_id {kind}, asked {dict(questions.dtypes)['vector']}, cluster int, far double")

    def _blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def _first(self, asked: DataFrame, k: int, among: int = 64) -> DataFrame:
        """(question_id, cluster, block, low, high) where a question begins: of ``among`` blocks of its home, those next to it, until they hold k points."""
        by_distance = Window.partitionBy("cluster").orderBy("low", "block")
        numbered = self._blocks().withColumn("k", F.row_number().over(by_distance) - 1).withColumn("step", F.ceil(F.count("*").over(Window.partitionBy("cluster")) / among))
        gap = F.greatest(F.col("low") - F.col("far"), F.col("far") - F.col("high"), F.lit(0.0))
        near = asked.select("question_id", "cluster", "far").join(numbered.where("k % step = 0"), "cluster").withColumn("gap", gap)
        before = F.sum("n").over(Window.partitionBy("question_id").orderBy("gap", "low", "block").rowsBetween(Window.unboundedPreceding, -1))
        return near.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).select("question_id", "cluster", "block", "low", "high")

    def _reached(self, asked: DataFrame, bounds: DataFrame) -> DataFrame:
        """(question_id, cluster, block, low, high) of all blocks that may hold one of a question's k best.

        bounds: (question_id, least, and ids) of the k-th best so far, where there are k. A block whose
        points can at most tie with it and have greater ids is left out, so that copies of a vector
        don't all meet one another.
        """
        kind, dimensions, pivots, low, high, there = dict(asked.dtypes)["question_id"], self.dimensions, self.pivots, self.low, self.high, self.n > 0

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = _units(batch.column(1), dimensions)[1]
                least = batch.column(2).fill_null(-1.0).to_numpy(zero_copy_only=False)
                own, far, radius = _routes(unit, least, pivots, low, high, there)
                row, cluster = np.nonzero(own)
                d = far[row, cluster]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cluster, pa.int32()), pa.array(d), pa.array(radius[row])], ["question_id", "cluster", "far", "radius"])

        known = bounds.select("question_id", "least", F.struct(*self.ids).alias("last"))
        routes = asked.select("question_id", "asked").join(known.drop("last"), "question_id", "left").mapInArrow(reach, f"question_id {kind}, cluster int, far double, radius double")
        blocks = self._blocks().select("cluster", "block", "low", "high", "first")
        gap = F.greatest(F.col("low") - F.col("far"), F.col("far") - F.col("high"), F.lit(0.0))
        near = routes.join(blocks, "cluster").withColumn("gap", gap - BLUR).where(F.col("gap") <= F.col("radius")).join(known, "question_id", "left")
        tie = (F.round(1 - F.pow(F.greatest("gap", F.lit(0.0)), 2) / 2, 6) <= F.col("least")) & (F.col("first") > F.col("last"))
        return near.where(~F.coalesce(tie, F.lit(False))).select("question_id", "cluster", "block", "low", "high")

    def _visited(self, pairs: DataFrame) -> DataFrame:
        """The points of what is met: clusters by their folders, and within one what lies in the distances of its blocks."""
        ranges = pairs.groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        return self._between({r["cluster"]: (r["low"], r["high"]) for r in ranges})

    def _between(self, ranges: dict[int, tuple[float, float]]) -> DataFrame:
        """The points of these clusters whose distances lie in their ranges, looked up by the cluster's number."""
        points = self._read(self.spark, self.folder, self.ids, self.kind)
        if not ranges:
            return points.where(F.lit(False))
        lows, highs = ([ranges.get(c, (np.inf, -np.inf))[side] for c in range(max(ranges) + 1)] for side in (0, 1))
        at = lambda bounds: F.get(F.lit([float(x) for x in bounds]), F.col("cluster"))
        some = points.where(F.col("cluster").isin(list(ranges)) & F.col("distance").between(float(min(lows)), float(max(highs))))
        return some.where(F.col("distance").between(at(lows), at(highs)))

    def _in_place(self, asked: DataFrame, k: int) -> DataFrame:
        """(question_id, score, ids) as of ``_scored``, for questions that each task can have whole: points are met where they lie, and none is moved."""
        table, first = asked.select("question_id", "asked").toArrow().combine_chunks(), self._first(asked, k).collect()
        kind, known = dict(asked.dtypes)["question_id"], table["question_id"]
        wide = _units(table["asked"].combine_chunks(), self.dimensions)[1] if len(known) else np.zeros((0, self.dimensions))
        number, begins, ranges = {q: n for n, q in enumerate(known.to_pylist())}, {}, {}
        for r in first:
            begins.setdefault((r["cluster"], r["block"]), []).append(number[r["question_id"]])
            low, high = ranges.get(r["cluster"], (np.inf, -np.inf))
            ranges[r["cluster"]] = min(low, r["low"]), max(high, r["high"])
        blocks = F.broadcast(self.spark.createDataFrame(list(begins), "cluster int, block bigint"))
        least = np.full(len(known), -np.inf)
        begun = self._best(self._between(ranges).join(blocks, ["cluster", "block"], "left_semi"), k, known, kind, wide, least, begins=begins)
        for r in self._ranked(begun, k).where(F.col("rank") == k).select("question_id", "score").collect():
            least[number[r["question_id"]]] = r["score"]
        own, far, radius = routes = _routes(wide, np.maximum(least, -1.0), self.pivots, self.low, self.high, self.n > 0)
        near, end = np.where(own, far - radius[:, None], np.inf).min(0, initial=np.inf), np.where(own, far + radius[:, None], -np.inf).max(0, initial=-np.inf)
        ranges = {int(c): (near[c] - BLUR, end[c] + BLUR) for c in np.flatnonzero(own.any(0))}
        return self._best(self._between(ranges), k, known, kind, wide, least, routes=routes)

    def _best(self, points: DataFrame, k: int, questions: pa.ChunkedArray, kind: str, wide: np.ndarray, least: np.ndarray, begins: dict | None = None, routes: tuple | None = None) -> DataFrame:
        """(question_id, score, ids): each task's k best of the questions, among those that score ``least`` or more; a block is met by those of ``begins``, or by those that ``routes`` lead to it."""
        ids, dimensions = self.ids, self.dimensions
        sent, arrow = self.spark.sparkContext.broadcast(pickle.dumps((questions.to_pylist(), wide, least, begins, routes))), questions.type

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, wide, least, begins, routes = pickle.loads(sent.value)  # noqa: S301  sent by this driver
            best = Best([(dimensions, known, wide)], k)
            best.least[0][:] = least
            for batch in batches:
                cluster, block, distance = (batch.column(len(ids) + c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                edges = np.flatnonzero((np.diff(cluster) != 0) | (np.diff(block) != 0)) + 1
                for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                    if begin == end:
                        continue
                    c = cluster[begin]
                    if begins is not None:
                        who = np.array(begins.get((c, block[begin]), []), np.int64)
                    else:
                        own, far, radius = routes
                        who = np.flatnonzero(own[:, c] & (far[:, c] - radius <= distance[begin:end].max() + BLUR) & (far[:, c] + radius >= distance[begin:end].min() - BLUR))
                    if len(who):
                        best.add([batch.column(i).slice(begin, end - begin) for i in range(len(ids))], batch.column(len(ids)).slice(begin, end - begin), who=who)
            yield pa.RecordBatch.from_arrays(best.rows(arrow, len(ids)), ["question_id", "score", *ids])

        schema = f"question_id {kind}, score double, {', '.join(f'{i} bigint' for i in ids)}"
        return points.select(*ids, "vector", "cluster", "block", "distance").mapInArrow(meet, schema)

    def _scored(self, asked: DataFrame, pairs: DataFrame, k: int, most: int = 8192, bundle: int = 64) -> DataFrame:
        """(question_id, score, ids): the k best of each question in each bundle of blocks that it meets, by matrix products.

        ``bundle`` blocks, whatever their clusters, are one group, to which a question goes once with the
        numbers of the blocks that it meets there: vectors are dealt once a bundle, not once a block. A bundle that many
        questions meet is dealt to several tasks, ``most`` questions each on average; no pair of vectors is ever a row.
        """
        ids, dimensions, kind = self.ids, self.dimensions, dict(asked.dtypes)["question_id"]
        # blocks are numbered along the clusters, so a bundle's are neighbours; rows of blocks are few
        number = F.row_number().over(Window.orderBy("cluster", "block")) - 1
        numbered = self._blocks().select("cluster", "block", number.alias("of")).withColumn("bundle", F.floor(F.col("of") / bundle).cast("int"))
        own = pairs.select("question_id", "cluster", "block").join(F.broadcast(numbered), ["cluster", "block"])
        met = own.groupBy("question_id", "bundle").agg(F.sort_array(F.collect_set("of")).alias("met"))
        crowds = F.broadcast(own.groupBy(F.col("bundle").alias("crowd")).agg(F.ceil(F.count_distinct("question_id") / most).cast("int").alias("parts")))
        crowded = lambda df: df.join(crowds, F.col("bundle") == F.col("crowd"))
        blocks = F.broadcast(own.select("cluster", "block", "of", "bundle").distinct())  # what no question meets stays where it is
        there = crowded(self._visited(pairs).join(blocks, ["cluster", "block"])).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        names = ["question_id", "score", *ids]
        schema = f"question_id {kind}, score double, {', '.join(f'{i} bigint' for i in ids)}"

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            known = right["question_id"].to_pylist() if left.num_rows else []
            best = Best([(dimensions, known, _units(right["asked"].combine_chunks(), dimensions)[1])] if known else [], k)
            if known:
                sets = right["met"].combine_chunks()
                asks = np.repeat(np.arange(len(known)), sets.value_lengths().to_numpy(zero_copy_only=False))
                blocks, of = sets.flatten().to_numpy(zero_copy_only=False), left["of"].to_numpy()
                by_block = np.argsort(blocks, kind="stable")
                at = np.argsort(of, kind="stable")
                for n in np.unique(of):
                    who = asks[by_block[np.searchsorted(blocks, n, "left", by_block) : np.searchsorted(blocks, n, "right", by_block)]]
                    rows = pa.array(at[np.searchsorted(of, n, "left", at) : np.searchsorted(of, n, "right", at)])
                    if len(who):
                        best.add([left[i].take(rows).combine_chunks() for i in ids], left["vector"].take(rows).combine_chunks(), who=who)
            return pa.Table.from_arrays(best.rows(right.schema.field("question_id").type, len(ids)), names)

        by = ("bundle", "part")
        dealt = crowded(met.join(asked.select("question_id", "asked"), "question_id")).withColumn("part", F.pmod(F.xxhash64("question_id"), F.col("parts")).cast("int"))
        return there.select(*by, "of", *ids, "vector").groupBy(*by).cogroup(dealt.select(*[F.col(c).alias(f"{c}_") for c in by], "question_id", "asked", "met").groupBy(*[f"{c}_" for c in by])).applyInArrow(score, schema)

    def _found(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(questions that can have hits, the blocks that each has to meet)."""
        asked = written(self._asked(questions))
        return asked, self._pairs(asked, k)

    def _pairs(self, asked: DataFrame, k: int) -> DataFrame:
        first = written(self._first(asked, k))
        bounds = written(self._ranked(self._scored(asked, first, k), k).where(F.col("rank") == k).withColumnRenamed("score", "least"))
        return written(self._reached(asked, bounds))

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), *self.ids)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, questions: DataFrame, k: int = 3) -> DataFrame:
        """(question_id, rank, score, ids) as ``retrieval.top_k`` gives it, the same rows; questions: question_id (once each), vector.

        A question of another length, null, zero or not finite has no hits. All questions share one
        scan of what they have to meet; their number has no bound. Up to 64 MB of them go to the tasks
        and points stay where they lie; more are dealt to tasks with the blocks that they meet.
        """
        if not self.n.sum():
            kind = dict(questions.dtypes)["question_id"]
            return self.spark.createDataFrame([], f"question_id {kind}, rank int, score double, {', '.join(f'{i} bigint' for i in self.ids)}")
        asked = written(self._asked(questions))
        if asked.count() * (self.dimensions * 8 + 64) <= MOST_ASKED:
            found = self._in_place(asked, k)
        else:
            found = self._scored(asked, self._pairs(asked, k), k)
        return self._ranked(found, k).select("question_id", "rank", "score", *self.ids)

    def visits(self, questions: DataFrame, k: int = 3) -> dict[str, int]:
        """What a search of these questions has to meet: clusters, files and pairs of question and block, each beside how many there are."""
        asked, pairs = self._found(questions, k)
        whole, blocks = self._read(self.spark, self.folder, self.ids, self.kind), self._blocks()
        return {
            "files": self._visited(pairs).select(F.input_file_name()).distinct().count(), "all_files": len(whole.inputFiles()), "clusters": pairs.select("cluster").distinct().count(), "all_clusters": int((self.n > 0).sum()),
            "pairs": pairs.count(), "all_pairs": asked.count() * blocks.count(),
        }
