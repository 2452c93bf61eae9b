"""Landed files as a stream: each is read once, and what cannot be read is set apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import PipelineConfig
from ..plans.service import documents_of
from ..schemas import RAW
from ..sources.files import dispatched

DOCUMENTS = "doc_id bigint, source_file string, text string, status string"
DEAD = "source_file string, status string, length bigint"


def follow_files(spark: SparkSession, source: str, target: str, checkpoint: str, config: PipelineConfig | None = None, files_at_once: int = 1000, archive: str | None = None) -> StreamingQuery:
    """Documents of each new file in ``source`` go to ``target``/documents, what cannot be read to ``target``/rejected.

    Stops when all that is there is done. A batch writes folders of its own number and replaces what an
    attempt before it left there, so each file counts once, whatever fails between. With ``archive``,
    files that are done move there. A file that goes before it is read is left out.
    """
    options = {"maxFilesPerTrigger": str(files_at_once), "ignoreMissingFiles": "true"}
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}

    def load(batch: DataFrame, number: int) -> None:
        read = documents_of(dispatched(batch), config, "length").persist()
        try:
            read.where("status = 'ok'").drop("length").write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
            read.where("status <> 'ok'").select("source_file", "status", "length").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
        finally:
            read.unpersist()

    stream = spark.readStream.format("binaryFile").schema(RAW).options(**options).load(source)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def documents(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, source_file, text, status) of what ``follow_files`` has read."""
    return _table(spark, f"{target}/documents", DOCUMENTS)


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """(source_file, status, length) of the files that it could not read."""
    return _table(spark, f"{target}/rejected", DEAD)


class Timings(StreamingQueryListener):
    """``rows``: query, batch, seconds and rows of each batch of the streams that the session runs (A5).

    rows are those that Spark counts as read, a file's row as often as its batch was read.
    """

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.rows.append({"query": str(p.id), "batch": p.batchId, "seconds": p.durationMs.get("triggerExecution", 0) / 1000, "rows": p.numInputRows})

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, batch bigint, seconds double, rows bigint")
