"""Where documents come from and where results go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parsers import format_of
from ..schemas import POINTS, RAW


def extension(url: Column) -> Column:
    """What follows the last full stop before any query, in lower case; a fragment stays part of it (S3)."""
    return F.lower(F.element_at(F.split(F.element_at(F.split(url, r"\?"), 1), r"\."), -1))


def landed(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Files that were fetched: path, content, extension and format (S1, S2, S7). No file: no rows."""
    return dispatched(spark.read.format("binaryFile").schema(RAW).load(path), strict).drop("length")


def dispatched(files: DataFrame, strict: bool = False) -> DataFrame:
    """Files as ``binaryFile`` gives them, as a table or as a stream: path, length, content, extension and format."""
    return files.select("path", "length", "content", extension(F.col("path")).alias("ext")).withColumn("format", format_of(F.col("ext"), strict))


def shared_folder(spark: SparkSession) -> str:
    """A new name under the folder that driver and executors share (spark.checkpoint.dir); a temporary folder where none is set on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="veldspar-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        top = f"file://{own}"
    return f"{top.rstrip('/')}/files-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder, for what reads them more than once; lineage ends there."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt to as many tasks as can run at once, where its bytes, as planned, give fewer; large inputs stay as they are read."""
    spark = docs.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(tasks) if planned < tasks * (128 << 20) else docs


def write_texts(docs: DataFrame, path: str) -> None:
    """(doc_id, text) as Parquet (S9); line feeds become spaces."""
    docs.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A document's chunks as a JSON array a line, in order (S11); a document without chunks is no line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    chunks.groupBy("doc_id").agg(ordered.alias("chunks")).write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, chunk_index, text) of what ``write_chunks`` wrote (S12); a missing path raises."""
    return spark.read.schema("doc_id bigint, chunks array<string>").json(path).select("doc_id", F.posexplode("chunks").alias("chunk_index", "text"))


def write_points(points: DataFrame, path: str) -> None:
    """Points as JSON lines in gzip, as plain zeros of vectors are many times the input; other alphabets as they are."""
    points.write.mode("overwrite").json(path, compression="gzip")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of what ``write_points`` wrote."""
    return spark.read.schema(POINTS).json(path)
