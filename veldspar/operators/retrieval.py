"""Nearest points of a set of questions."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is said where there is nothing.
NOTHING, NO_TEXT, NO_RESULTS = "No relevant answers found.", "No text found.", "No relevant information found."


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of a list column: the rows whose vector has ``width`` finite components, not all of them zero."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    norms = np.linalg.norm(flat, axis=1)
    good = np.isfinite(norms) & (norms > 0)  # a null is not a number, and so is the norm
    return rows[good], flat[good] / norms[good, None]


class Best:
    """The k best (-score, *ids) of each question of some groups (width, question ids, unit vectors), ties to the smaller ids.

    Scores are told from one another by arrays; only those that reach what a question has already are looked at one by one.
    """

    def __init__(self, groups: list[tuple[int, list, np.ndarray]], k: int):
        self.groups, self.k = groups, k
        self.held: list[list[list[tuple]]] = [[[] for _ in known] for _, known, _ in groups]
        self.least = [np.full(len(known), -np.inf) for _, known, _ in groups]

    def add(self, ids: list[pa.Array], column: pa.Array, most: int = 1024, who: np.ndarray | None = None) -> None:
        """Points with these ids and vectors; ``most`` of them are scored at a time, so that no matrix grows with the batch. ``who``: places of the questions that meet them, where there is one group."""
        for at in range(0, len(column), most):
            self._slice([i.slice(at, most) for i in ids], column.slice(at, most), who, most)

    def _slice(self, ids: list[pa.Array], column: pa.Array, who: np.ndarray | None, most: int) -> None:
        for (width, _, wide), held, least in zip(self.groups, self.held, self.least, strict=True):
            rows, vectors = _units(column, width)
            if len(rows) and who is None:
                self._add(np.round(wide @ vectors.T, 6), ids, rows, held, least)
            elif len(rows):
                for some in (who[k : k + 2 * most] for k in range(0, len(who), 2 * most)):
                    part, bound = [held[q] for q in some.tolist()], least[some]
                    self._add(np.round(wide[some] @ vectors.T, 6), ids, rows, part, bound)
                    least[some] = bound
                    for q, best in zip(some.tolist(), part, strict=True):
                        held[q] = best

    def _add(self, scores: np.ndarray, ids: list[pa.Array], rows: np.ndarray, held: list[list[tuple]], least: np.ndarray) -> None:
        bound = least
        if scores.shape[1] > self.k and np.isneginf(least).any():
            bound = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        question, point = np.nonzero(scores >= bound[:, None])
        if not len(question):
            return
        take = pa.array(rows[point])
        found = list(zip((-scores[question, point]).tolist(), *(i.take(take).to_pylist() for i in ids), strict=True))
        edges = [0, *(np.flatnonzero(np.diff(question)) + 1).tolist(), len(question)]
        for begin, end in zip(edges, edges[1:], strict=False):
            q = question[begin]
            held[q] = sorted(held[q] + found[begin:end])[: self.k]
            if len(held[q]) == self.k:
                least[q] = -held[q][-1][0]

    def rows(self, kind: pa.DataType, n_ids: int) -> list[pa.Array]:
        """question_id, score and ids, as columns."""
        out = [(q, -s, *point) for (_, known, _), held in zip(self.groups, self.held, strict=True) for q, best in zip(known, held, strict=True) for s, *point in best]
        return [pa.array([r[c] for r in out], t) for c, t in enumerate((kind, pa.float64(), *[pa.int64()] * n_ids))]


def top_k(points: DataFrame, questions: DataFrame, k: int = 3, block: int = 2048, scope: str | None = None, ids: tuple[str, ...] = ("id",), blocks: int = 8) -> DataFrame:
    """(question_id, rank, score, and ``ids``) of each question's k nearest points by cosine.

    ``points``: ``ids`` (whole numbers) and vector; ``questions``: question_id, vector. A point is a hit
    if its vector is as long as the question's, finite and not zero; each is judged by itself. Ties go to
    the smaller id. ``scope``: a column of both, on which point and question must agree, so a question
    meets no other points; a null agrees with nothing. Otherwise the questions are the stated query
    set: ``blocks`` blocks of at most ``block`` go to the executors at a time, each scored against all
    points by matrix products; a task keeps the best k of each question.
    """
    kind = dict(questions.dtypes)["question_id"]
    names, schema = ["question_id", "score", *ids], f"question_id {kind}, score double, {', '.join(f'{i} bigint' for i in ids)}"
    found = _within(points, questions, k, scope, ids, names, schema) if scope else _among_all(points, questions, k, block, blocks, ids, names, schema)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *ids))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "score", *ids)


#: Questions of a document's scope that each task gets whole, in bytes of their vectors; more of them are dealt out with their documents.
MOST_ASKED = 64 << 20


def _by_width(known: list, column: pa.Array) -> list[tuple[int, list, np.ndarray]]:
    """(width, question ids, unit vectors) of questions, by the length of their vectors."""
    groups = []
    for width in filter(None, pc.unique(pc.fill_null(pc.list_value_length(column), 0)).to_pylist()):
        rows, wide = _units(column, width)
        groups.append((width, [known[r] for r in rows.tolist()], wide))
    return groups


def _within(points: DataFrame, questions: DataFrame, k: int, scope: str, ids: tuple[str, ...], names: list[str], schema: str, most: int = MOST_ASKED) -> DataFrame:
    """The k best of each question among the points that agree with it on ``scope``, a few for each task that had some.

    If the questions' vectors have ``most`` bytes or fewer they go to the tasks, and no point is moved: a
    document with very many points is met wherever its points lie. Otherwise points and questions of a
    document are dealt to tasks together, in parts of a bounded number of either. No pair is ever a row.
    """
    asked = questions.where(F.col(scope).isNotNull()).select("question_id", "vector", F.col(scope).alias("_scope"))
    there = points.select(*[F.col(i).cast("bigint").alias(i) for i in ids], "vector", F.col(scope).alias("_scope"))
    size = asked.agg(F.sum(F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)).cast("long") * 8 + 64)).first()[0] or 0
    return _in_place(there, asked, k, ids, names, schema) if size <= most else _dealt(there, asked, k, ids, names, schema)


def _in_place(there: DataFrame, asked: DataFrame, k: int, ids: tuple[str, ...], names: list[str], schema: str) -> DataFrame:
    table = asked.toArrow().combine_chunks()
    kind, places = table.schema.field("question_id").type, {}
    for row, value in enumerate(table["_scope"].to_pylist()):
        places.setdefault(value, []).append(row)
    vectors = table["vector"].combine_chunks() if table.num_rows else None
    groups = {value: _by_width(table["question_id"].take(pa.array(rows)).to_pylist(), vectors.take(pa.array(rows))) for value, rows in places.items()}
    sent = asked.sparkSession.sparkContext.broadcast(pickle.dumps(groups))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = pickle.loads(sent.value)  # noqa: S301  sent by this driver
        held: dict = {}
        for batch in batches:
            of: dict = {}
            for row, value in enumerate(batch.column(len(ids) + 1).to_pylist()):
                if value in groups:
                    of.setdefault(value, []).append(row)
            for value, rows in of.items():
                part = batch.take(pa.array(rows))
                if value not in held:
                    held[value] = Best(groups[value], k)
                held[value].add(part.columns[: len(ids)], part.column(len(ids)))
        for best in held.values():
            yield pa.RecordBatch.from_arrays(best.rows(kind, len(ids)), names)

    return there.mapInArrow(best, schema)


def _dealt(there: DataFrame, asked: DataFrame, k: int, ids: tuple[str, ...], names: list[str], schema: str, block: int = 8192) -> DataFrame:
    n_asked = asked.groupBy("_scope").agg(F.ceil(F.count("*") / block).cast("int").alias("asked_parts"))
    met = there.join(n_asked.select("_scope"), "_scope", "left_semi")
    parts = met.groupBy("_scope").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).join(n_asked, "_scope")
    all_, own = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    points = met.join(parts, "_scope").select("_scope", own("parts", *ids).alias("_a"), all_("asked_parts").alias("_b"), *ids, "vector")
    questions = asked.join(parts, "_scope").select("_scope", all_("parts").alias("_a"), own("asked_parts", "question_id").alias("_b"), "question_id", "vector")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        both = left.num_rows and right.num_rows
        held = Best(_by_width(right["question_id"].to_pylist(), right["vector"].combine_chunks()) if both else [], k)
        if both:
            held.add([left[i].combine_chunks() for i in ids], left["vector"].combine_chunks())
        return pa.Table.from_arrays(held.rows(right.schema.field("question_id").type, len(ids)), names)

    by = ("_scope", "_a", "_b")
    return points.groupBy(*by).cogroup(questions.groupBy(*by)).applyInArrow(best, schema)


def _among_all(points: DataFrame, questions: DataFrame, k: int, block: int, blocks: int, ids: tuple[str, ...], names: list[str], schema: str) -> DataFrame:
    spark, found = questions.sparkSession, None
    n = max(1, -(-questions.count() // (block * blocks)))
    numbered = questions.withColumn("_part", F.pmod(F.xxhash64("question_id"), F.lit(n)))
    for part in range(n):
        asked = numbered.where(F.col("_part") == part).select("question_id", "vector").toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        kind = asked.schema.field("question_id").type
        groups = [(width, known[at : at + block], wide[at : at + block]) for width, known, wide in _by_width(asked["question_id"].to_pylist(), asked["vector"].combine_chunks()) for at in range(0, len(known), block)]
        sent = spark.sparkContext.broadcast(pickle.dumps(groups))

        def best(batches: Iterator[pa.RecordBatch], sent=sent, kind=kind) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            held = Best(pickle.loads(sent.value), k)  # noqa: S301  sent by this driver
            for batch in batches:
                held.add(batch.columns[: len(ids)], batch.column(len(ids)))
            yield pa.RecordBatch.from_arrays(held.rows(kind, len(ids)), names)

        hits = points.select(*[F.col(i).cast("bigint").alias(i) for i in ids], "vector").mapInArrow(best, schema)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], schema)


def payload_text(payload: Column) -> Column:
    """The payload's text, or a sentence in its place."""
    return F.coalesce(payload["text"], F.lit(NO_TEXT))


def contexts(questions: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, contexts): texts of a question's hits, best first; k times a sentence where there is none."""
    ordered = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("contexts"))
    return questions.select("question_id").join(ordered, "question_id", "left").withColumn("contexts", F.coalesce("contexts", F.array_repeat(F.lit(NOTHING), k)))


def distinct_questions(questions: DataFrame) -> DataFrame:
    """A question that a request asks twice counts once, at its first place."""
    return questions.groupBy("request_id", "question").agg(F.min("q_pos").alias("q_pos"))


def formatted(results: Column) -> Column:
    """Each question's contexts as one text, or a sentence where there are no results."""
    said = F.transform(results, lambda r: F.to_json(r))
    return F.when(F.size(results) > 0, said).otherwise(F.array(F.lit(NO_RESULTS)))
