"""Requests as a keyed stream: each waits until its document is there, is answered once, or runs out of time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..config import PipelineConfig
from ..plans.service import answer

#: What happens to a request: kind is ``asked`` (with doc_id and questions) or ``ingested`` (its document is in the store).
EVENTS = "request_id string, kind string, doc_id bigint, questions array<string>, at timestamp"
DECIDED = "request_id string, phase string, doc_id bigint, questions array<string>"
ANSWERS = "request_id string, q_pos int, question string, answer string, status string"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Progress(StatefulProcessor):
    """The phases of one request: waiting, then ready or timed_out, of which one row tells, and forgotten after a while.

    Events may come in any order and any number of times. Time is that of the events: a request that
    waits for its document, or a document for its request, for more than ``patience`` milliseconds is
    timed out. What is done is known for ``remember`` milliseconds, in which repeated events change nothing.
    """

    def __init__(self, patience: int, remember: int):
        self.patience, self.remember = patience, remember

    def init(self, handle: Any) -> None:  # noqa: ANN401
        self.handle = handle
        self.state = handle.getValueState("request", "phase string, asked boolean, ingested boolean, doc_id bigint, questions array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        held = self.state.get() if self.state.exists() else None
        phase, asked, ingested, doc_id, questions = held if held is not None else ("waiting", False, False, None, None)
        began = None
        for row in rows:
            if row.at is not None:
                at = int(row.at.timestamp() * 1000)
                began = at if began is None else min(began, at)
            if row.kind == "asked" and not asked:
                asked, doc_id, questions = True, row.doc_id, list(row.questions or [])
            ingested = ingested or row.kind == "ingested"
        if phase == "waiting" and asked and ingested:
            phase = "ready"
            self._only_timer(max(timerValues.getCurrentWatermarkInMs(), began or 0) + self.remember)
            yield Row(request_id=key[0], phase=phase, doc_id=doc_id, questions=questions)
            questions = None
        elif held is None:
            self._only_timer((began or timerValues.getCurrentWatermarkInMs()) + self.patience)
        self.state.update((phase, asked, ingested, doc_id, questions))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: ANN401, N802, N803
        phase, asked, ingested, doc_id, questions = self.state.get()
        if phase != "waiting":
            self.state.clear()
            return
        self._only_timer(timerValues.getCurrentWatermarkInMs() + self.remember)
        self.state.update(("timed_out", asked, ingested, doc_id, None))
        yield Row(request_id=key[0], phase="timed_out", doc_id=doc_id, questions=questions)

    def _only_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at))

    def close(self) -> None:
        pass


def decided(events: DataFrame, patience: int = 20_000, remember: int = 3_600_000, late: str = "0 seconds") -> DataFrame:
    """(request_id, phase, doc_id, questions) of a stream of ``EVENTS``: one row a request, ready or timed_out.

    Events without a request_id belong to none and are left out. ``late``: how far behind the newest
    event others may come and still be told of time by.
    """
    keyed = events.where("request_id is not null and at is not null").withWatermark("at", late).groupBy("request_id")
    return keyed.transformWithState(statefulProcessor=Progress(patience, remember), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime")


def answer_stream(events: DataFrame, points: Callable[[], DataFrame], target: str, checkpoint: str, config: PipelineConfig | None = None, **times: Any) -> StreamingQuery:  # noqa: ANN401
    """Answers of each request that becomes ready go to ``target``, as ``answer`` gives them; one that ran out of time is a row of its own.

    ``points`` is asked once a batch, for what the store holds then. A batch writes a folder of its own
    and replaces what an attempt before it left, so each request is answered once, whatever fails
    between. Stops when all events that are there are done. The session's state store is RocksDB for
    this query, as timers need it.
    """
    spark = events.sparkSession

    def load(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            asked = rows.where("phase = 'ready'").select("request_id", "doc_id", F.posexplode("questions").alias("q_pos", "question"))
            told = answer(points(), asked.select("request_id", "q_pos", "question", "doc_id"), config).select("request_id", "q_pos", "question", "answer", "status")
            out = rows.where("phase = 'timed_out'").select("request_id", F.lit(None).cast("int").alias("q_pos"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit("timed_out").alias("status"))
            told.unionByName(out).write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            rows.unpersist()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return decided(events, **times).writeStream.foreachBatch(load).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def answers(spark: SparkSession, target: str) -> DataFrame:
    """(request_id, q_pos, question, answer, status) of what ``answer_stream`` wrote."""
    return spark.read.schema(f"{ANSWERS}, batch bigint").parquet(target).drop("batch")
