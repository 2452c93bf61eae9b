"""Incremental ingestion: an extension beside what the service does in one request."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import PipelineConfig
from ..operators.store import Store
from ..plans.service import ingest


def follow(spark: SparkSession, documents: str, schema: str, store: Store, collection: str, checkpoint: str, config: PipelineConfig | None = None) -> StreamingQuery:
    """Points of each new Parquet file of ``documents`` go to ``collection``; stops when all that is there is done.

    A batch is a version of its own, named after the checkpoint and its number: one that is repeated
    after a failure counts once, and what the collection held before stays.
    """
    config = config or PipelineConfig()
    store.create(collection, config.dimensions)
    run = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def load(batch: DataFrame, number: int) -> None:
        store.write(collection, ingest(batch, config), run, number)

    stream = spark.readStream.schema(schema).parquet(documents)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
