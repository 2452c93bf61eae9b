"""The service's two halves as plans: documents to points, and questions to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.slices import small_batches
from ..operators import answering, chunking, cleaning, embedding, parsers, retrieval
from ..operators.index import Index
from ..sources import files, http

VERSION = "0.1.0"


def engine_info(spark: SparkSession) -> DataFrame:
    """One row about the engine (A2)."""
    return spark.range(1).select(F.lit("veldspar").alias("name"), F.lit(VERSION).alias("version"), F.lit("Document question answering on Spark").alias("description"), F.lit("README.md").alias("docs"))


def allowed(scheme: Column, token: Column, api_key: Column, config: PipelineConfig) -> Column:
    """Whether a request may pass (A3): authentication off, or the bearer token.

    Any API key that is not empty passes only where ``accept_any_api_key`` says so; it protects nothing.
    """
    digest = F.sha2(F.coalesce(token, F.lit("")), 256)
    bearer = (F.lower(F.coalesce(scheme, F.lit(""))) == "bearer") & token.isNotNull() & (digest == F.sha2(F.lit(config.auth_token), 256))
    key = F.lit(config.accept_any_api_key) & (F.coalesce(api_key, F.lit("")) != "")
    return F.lit(not config.auth_enabled) | bearer | key


def http_status(status: Column) -> Column:
    """The code that a status becomes."""
    return F.when(status.isin("ok", "answer_count_mismatch"), 200).when(status == "not_found", 404).when(status.isin("unsupported", "parse_error", "backend_missing"), 404).when(status == "too_large", 413).when(status == "unauthorized", 401).otherwise(500)


def read_documents(spark: SparkSession, path: str, config: PipelineConfig | None = None) -> DataFrame:
    """Landed files as (doc_id, source_file, text, status), cleaned, tables behind the text."""
    return documents_of(files.landed(spark, path), config)


def documents_of(landed: DataFrame, config: PipelineConfig | None = None, *also: str) -> DataFrame:
    """The same of files (path, content, ext, format) that are at hand; ``also`` are further columns to keep."""
    config = config or PipelineConfig()
    parsed = parsers.parsed(landed)
    texts = parsers.document_text(parsed, config.suppress_none, config.row_terminator)
    return texts.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_file"), F.col("doc_text").alias("text"), "status", *also)


def download(requests: DataFrame, config: PipelineConfig | None = None) -> DataFrame:
    """(doc_id, source_file, text, status) of requests (request_id, document_url): fetched, dispatched, parsed, cleaned."""
    config = config or PipelineConfig()
    parsed = parsers.parsed(http.fetched(requests))
    texts = parsers.document_text(parsed, config.suppress_none, config.row_terminator)
    status = F.when(F.col("fetch_status") != "ok", F.col("fetch_status")).otherwise(F.col("status"))
    return texts.select(F.xxhash64("request_id").alias("doc_id"), F.col("document_url").alias("source_file"), F.when(status == "ok", F.col("doc_text")).alias("text"), status.alias("status"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and what an action on it will have counted; the session's listeners get it with the action's duration (A5)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def request_times(answers: DataFrame, began: float) -> DataFrame:
    """(request_id, seconds, rows): from ``began`` (as of time.time()) until the last row of each request was made, and how many it has (A5).

    Rows are stamped by the task that makes them, batch by batch, so ``answers`` is run by this.
    """

    @F.arrow_udf("double")
    def now(rows):  # noqa: ANN001, ANN202
        import time

        import pyarrow as pa

        return pa.array([time.time()] * len(rows))

    stamped = answers.select("request_id", now.asNondeterministic()(F.col("request_id")).alias("at"))
    return stamped.groupBy("request_id").agg((F.max("at") - began).alias("seconds"), F.count("*").alias("rows"))


def ingest(docs: DataFrame, config: PipelineConfig | None = None, cleaned: bool = False, load: object = embedding.hashed_embedder) -> DataFrame:
    """Points of documents (doc_id, text, and source_file where it is known): clean, split, pack, encode.

    A document without chunks gives no point; ``ingest_status`` tells which. Where a few files hold
    all documents, rows are dealt out first, as packing is the dear part.
    """
    config = config or PipelineConfig()
    small_batches(docs.sparkSession)
    source = F.col("source_file") if "source_file" in docs.columns else F.lit(None).cast("string")
    dealt = files.spread(docs.select("doc_id", "text", source.alias("source_file")))
    texts = dealt.withColumn("cleaned", F.coalesce("text", F.lit(""))) if cleaned else cleaning.clean(dealt, config.strict_noise, config.ocr_fixes)
    rows = chunking.chunks(texts, "cleaned", config.chunk_size, config.chunk_overlap, also=("source_file",))
    return embedding.points(embedding.encoded(rows, load, config.prefix), F.col("source_file"), config.prefix)


def ingest_status(docs: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_id, status): ok or no_chunks."""
    there = points.select("doc_id").distinct().withColumn("there", F.lit(True))
    return docs.select("doc_id").distinct().join(there, "doc_id", "left").select("doc_id", F.when(F.col("there"), "ok").otherwise("no_chunks").alias("status"))


#: Hits that each task gets whole to look up their texts (about 10 MB); more are joined by a shuffle.
MOST_HITS = 100_000


def hits(points: DataFrame, questions: DataFrame, config: PipelineConfig | None = None, load: object = embedding.hashed_embedder, index: Index | None = None) -> DataFrame:
    """(question_id, rank, score, doc_id, id, text) of questions (question_id, question, and doc_id for the document's scope).

    ``index``: one of ``points`` by doc_id and id, which then answers in the corpus scope with the same rows.
    There are at most ``top_k`` hits a question: while these are few, texts are looked up where the points lie.
    """
    config = config or PipelineConfig()
    scope = "doc_id" if config.scope == "document" else None
    asked = embedding.encoded(questions.select("question_id", "question", *([scope] if scope else [])), load, config.prefix, text="question")
    found = index.search(asked, config.top_k) if index is not None and scope is None else retrieval.top_k(points, asked, config.top_k, scope=scope, ids=("doc_id", "id"))
    found = F.broadcast(found) if questions.count() * config.top_k <= MOST_HITS else found
    text = retrieval.payload_text(F.col("payload")).alias("text")
    return found.join(points.select("doc_id", "id", text), ["doc_id", "id"]).select("question_id", "rank", "score", "doc_id", "id", "text")


def answer(points: DataFrame, questions: DataFrame, config: PipelineConfig | None = None, load: object = embedding.hashed_embedder, generator: object = None, index: Index | None = None) -> DataFrame:
    """Answers to questions (request_id, q_pos, question, and doc_id for the document's scope) (A1).

    ``index`` is as in ``hits``.
    Without a ``generator`` the answer is the best sentence of the best context; with one, each
    request is one prompt and its reply is read as a list. status tells whether that worked.
    """
    config = config or PipelineConfig()
    keyed = questions.withColumn("question_id", F.xxhash64("request_id", "q_pos"))
    found = hits(points, keyed, config, load, index)
    with_context = keyed.join(retrieval.contexts(keyed, found, config.top_k), "question_id")
    if generator is None:
        best = F.col("contexts")[0]
        plain = F.when(best.startswith(config.prefix), F.expr(f"substr(contexts[0], {len(config.prefix) + 1})")).otherwise(best)
        return with_context.select("request_id", "q_pos", "question", answering.extractive(F.col("question"), plain).alias("answer"), F.lit("ok").alias("status"))
    asked = F.array_sort(F.collect_list(F.struct("q_pos", "question", "contexts")))
    grouped = with_context.groupBy("request_id").agg(asked.alias("asked"))
    requests = grouped.withColumn("prompt", answering.prompt(F.transform("asked", lambda q: q["question"]), F.transform("asked", lambda q: F.struct(q["question"].alias("question"), q["contexts"].alias("contexts")))))
    read = answering.generated(requests, generator).withColumn("read", answering.read_answers("completion"))
    status = F.when(~F.col("read.ok"), F.lit("no_answers")).otherwise(answering.count_status(F.col("asked"), F.col("read.answers")))
    told = F.get("answers", F.col("n"))
    numbered = read.select("request_id", F.posexplode("asked").alias("n", "q"), "read.answers", "read.ok", status.alias("status"))
    return numbered.select("request_id", "q.q_pos", "q.question", F.when(F.col("ok"), told).otherwise(F.get("answers", F.lit(0))).alias("answer"), "status")
