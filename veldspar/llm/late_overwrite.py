"""Late arrivals overwrite partitions: a layout of day files, a record index of it, and the rewrite of dirty days.

A layout keeps the latest-arrived row of each sale and cuts each day, in order of sold_at and
sale_id, into Parquet files of a fixed number of rows: ``folder/day=D/file_no=K``, with no other
file in a folder. An index, hash-partitioned by sale_id, maps each sale to the day and file in which
it stands. Late winners probe the index and are tagged with the place of the row that they
supersede. Days where a winner comes to stand or a superseded row stood are dirty: their files are
read again, merged with the winners and cut anew; all others are left as they are.

Throughout, a null sale_id is a sale of its own, a null arrived_at is earlier than all others and
counts as late, and a null sold_at is of day -1. Of rows that arrive at the same time the greatest
counts, by the columns in their order in the table with nulls least; rows that are equal are one.
Columns beyond the seven of ``sales`` are left behind. An empty table gives an empty folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import checkpointed, frugal, shared_dir, small_batches

COLUMNS = ("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority")
#: Where the files of one layout are cut: about as many files, whatever the rows.
FILES = 1100


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    at = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at)
    seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def day_of(df: DataFrame) -> Column:
    """Whole days since 1970 of sold_at, -1 for none."""
    at, day = micros(df, "sold_at"), F.lit(86_400_000_000)
    return F.coalesce(((at - F.pmod(at, day)) / day).cast("int"), F.lit(-1))


def with_copies(sales: DataFrame) -> DataFrame:
    """The seven columns and ``day``, and for a third of the sales of each fourth day a later copy beside the row.

    h is the CRC-32 of the decimal sale_id. Where 3 divides h and 4 the row's day (never that of a
    null sold_at), a copy has total + 1, sold_at h % 2 and arrived_at 1 + h % 97 days later; nulls stay.
    """
    rows = sales.select(*COLUMNS)
    rows = rows.withColumn("day", day_of(rows)).withColumn("h", F.crc32(F.col("sale_id").cast("string").cast("binary")))
    twice = F.coalesce((F.col("h") % 3 == 0) & (F.col("day") % 4 == 0), F.lit(False))
    dealt = rows.withColumn("copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    later = lambda days: F.make_dt_interval((F.coalesce(days, F.lit(0)) * F.col("copy")).cast("int"))
    moved = {
        "total": F.col("total") + F.when(F.col("copy") == 1, 1.0).otherwise(0.0), "sold_at": F.col("sold_at") + later(F.col("h") % 2), "arrived_at": F.col("arrived_at") + later(1 + F.col("h") % 97),
        "day": F.col("day") + F.when(F.col("sold_at").isNotNull(), F.coalesce(F.col("h") % 2, F.lit(0)) * F.col("copy")).otherwise(0).cast("int"),
    }
    return dealt.withColumns(moved).select(*COLUMNS, "day")


def latest(rows: DataFrame) -> DataFrame:
    """Each sale's latest-arrived row; combined before the shuffle, so a sale with very many rows is no large group."""
    rest = [c for c in (*COLUMNS, "day") if c not in ("sale_id", "arrived_at")]
    top = rows.groupBy("sale_id").agg(F.max(F.struct("arrived_at", *rest)).alias("top"))
    return top.select("sale_id", "top.*").select(*COLUMNS, "day")


def cut(rows: DataFrame, per_file: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``file_no``, rows (day, n_rows) of what each day has).

    Rows are range-partitioned by day, sold_at and sale_id, so a day with very many rows lies in many
    tasks. What a task has of each day is counted; sums of these counts, of which there are no more
    than tasks and days together, tell each row's place in its day.
    """
    order = ("day", "sold_at", "sale_id")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("task", F.shiftright("at", 33))
    runs = placed.groupBy("day", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by day order by task rows between unbounded preceding and 1 preceding), 0)")
    starts = runs.select("day", "task", (F.col("first") - before).alias("start"))
    numbered = placed.join(F.broadcast(starts), ["day", "task"]).withColumn("file_no", F.expr(f"cast((at - start) div {per_file} as int)"))
    return numbered.select(*COLUMNS, "day", "file_no"), runs.groupBy("day").agg(F.sum("n").alias("n_rows"))


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes rows with day and file_no below ``folder``: a task writes whole files, streaming; days that the rows have not are left alone."""
    ordered = rows.repartition("day", "file_no").sortWithinPartitions("day", "file_no", "sold_at", "sale_id")
    options = {"partitionOverwriteMode": "dynamic", "maxRecordsPerFile": "0"}
    ordered.select(*COLUMNS, "day", "file_no").write.mode("overwrite").options(**options).partitionBy("day", "file_no").parquet(folder)


def read_files(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of a layout with day and file_no; the schema is that of the seven columns."""
    return spark.read.schema(StructType([*schema.fields]).add("day", IntegerType()).add("file_no", IntegerType())).parquet(folder)


def start(rows: DataFrame, folder: str, per_file: int) -> None:
    """Writes the first layout of ``rows`` (as of ``with_copies``)."""
    write_files(cut(latest(rows), per_file)[0], folder)


def build_index(spark: SparkSession, folder: str, schema: StructType, place: str, buckets: int | None = None) -> str:
    """The record index of a layout: sale_id, day, file_no and arrived_at, as a table of ``buckets`` hash buckets by sale_id; its name.

    Its files lie in the folder ``place`` and stay there if the table is dropped. A probe by sale_id moves none of it.
    """
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"veldspar_records_{uuid.uuid4().hex}"
    rows = read_files(spark, folder, schema).select("sale_id", F.col("day").alias("old_day"), F.col("file_no").alias("old_file"), F.col("arrived_at").alias("old_arrived"))
    rows.repartition(n, "sale_id").write.bucketBy(n, "sale_id").option("path", place).saveAsTable(name)
    return name


def tagged(late: DataFrame, index: DataFrame) -> DataFrame:
    """Late winners with old_day and old_file of the row that each supersedes (null: a new sale).

    A late row that arrived no later than what stands (only one that has no arrived_at) is no winner.
    """
    probed = latest(late).join(index.withColumnRenamed("sale_id", "known").withColumn("stands", F.lit(True)), F.col("sale_id").eqNullSafe(F.col("known")), "left")
    wins = F.col("stands").isNull() | F.coalesce(F.col("arrived_at") > F.col("old_arrived"), F.col("arrived_at").isNotNull())
    return probed.where(wins).select(*COLUMNS, "day", "old_day", "old_file")


def overwrite(spark: SparkSession, winners: DataFrame, folder: str, schema: StructType, per_file: int) -> list[int]:
    """Makes the layout in ``folder`` that of all rows; returns the dirty days, which go to the driver as names of folders do.

    Only files of dirty days are read. They are replaced by Spark's dynamic overwrite, which stages
    the new ones first; then files beyond a day's new last one go.
    """
    winners = checkpointed(winners)
    days = winners.select(F.explode(F.array("day", "old_day")).alias("day")).where("day is not null").distinct()
    dirty = sorted(r[0] for r in days.collect())
    if not dirty:
        return []
    stood = read_files(spark, folder, schema).where(F.col("day").isin(dirty)).select(*COLUMNS, "day")
    gone = winners.where("old_day is not null").select(F.col("sale_id").alias("gone"))
    kept = stood.join(gone, F.col("sale_id").eqNullSafe(F.col("gone")), "left_anti")
    rows, counts = cut(kept.unionByName(winners.select(*COLUMNS, "day")), per_file)
    write_files(rows, folder)
    n = {r["day"]: -(-r["n_rows"] // per_file) for r in counts.collect()}
    store, top = fs.FileSystem.from_uri(folder)
    for day in dirty:
        there = store.get_file_info(fs.FileSelector(f"{top}/day={day}", allow_not_found=True))
        for old in there:
            if old.base_name.startswith("file_no=") and int(old.base_name[8:]) >= n.get(day, 0):
                store.delete_dir(old.path)
        if there and not n.get(day):
            store.delete_dir(f"{top}/day={day}")
    return dirty


REPORT = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string"
_MOST = (1 << 63) - 1


def report(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A row for each file of a layout, read back from the files.

    n_rows; cents: floor(100 total + 0.5) summed, null 0 (held within 64 bits); rows_crc: the sum of
    the CRC-32 of ``sale_id:sold_at:arrived_at``, times in microseconds, nulls empty; columns from
    the footer; ids_sha256 of the comma-joined sale_ids in the file's order (null: empty).
    """
    small_batches(spark)
    rows = read_files(spark, folder, schema)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = F.concat_ws(":", text(F.col("sale_id")), text(micros(rows, "sold_at")), text(micros(rows, "arrived_at")))
    cents = F.coalesce(F.floor(F.col("total") * 100 + 0.5), F.lit(0)).cast("long")
    at = F.col("_metadata.row_index")
    told = rows.select("day", "file_no", at.alias("at"), F.when(at == 0, F.col("_metadata.file_path")).alias("path"), text(F.col("sale_id")).alias("id"), cents.alias("cents"), F.crc32(line.cast("binary")).alias("crc"))
    ordered = told.repartition("day", "file_no").sortWithinPartitions("day", "file_no", "at")
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 3

    @frugal
    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}

        def done() -> list[tuple]:
            if not now:
                return []
            path = unquote(now["path"])
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as file:
                columns = ",".join(pq.read_schema(file).names)
            shown = place if store.type_name == "local" else path
            return [(*now["key"], now["n"], max(-_MOST - 1, min(_MOST, now["cents"])), now["crc"], shown, columns, now["sha"].hexdigest())]

        for batch in batches:
            if not batch.num_rows:
                continue
            day, file_no = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = [0, *(np.flatnonzero((np.diff(day) != 0) | (np.diff(file_no) != 0)) + 1).tolist(), batch.num_rows]
            out: list[tuple] = []
            for a, b in zip(edges, edges[1:], strict=False):
                key = (int(day[a]), int(file_no[a]))
                if now.get("key") != key:
                    out += done()
                    now = {"key": key, "n": 0, "cents": 0, "crc": 0, "sha": hashlib.sha256(), "path": batch.column(3)[a].as_py()}
                now["sha"].update(("," * bool(now["n"]) + ",".join(batch.column(4).slice(a, b - a).to_pylist())).encode())
                now["n"] += b - a
                now["cents"] += sum(batch.column(5).slice(a, b - a).to_pylist())
                now["crc"] += sum(batch.column(6).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 8, kinds, strict=True)], names)
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 8, kinds, strict=True)], names)

    return ordered.mapInArrow(sum_up, REPORT)


def layouts(spark: SparkSession, sales: DataFrame, until: str = "2024-03-20 00:00:00", folder: str | None = None) -> DataFrame:
    """The layout of the rows that arrived before ``until`` (UTC), then overwritten by all later ones: ``report`` with ``rewritten``.

    Files have 1 + floor(N / 1100) rows, N being the rows of ``sales``. ``folder`` is new; by default one in the shared folder.
    """
    folder = folder or f"{shared_dir(spark)}/sales-{uuid.uuid4()}"
    per_file = 1 + sales.count() // FILES
    rows = with_copies(sales)
    schema = rows.select(*COLUMNS).schema
    bound = F.lit(int(np.datetime64(until, "us").astype(int)))
    early = F.coalesce(micros(rows, "arrived_at") < bound, F.lit(False))
    start(rows.where(early), folder, per_file)
    index = build_index(spark, folder, schema, f"{shared_dir(spark)}/records-{uuid.uuid4()}")
    try:
        dirty = overwrite(spark, tagged(rows.where(~early), spark.table(index)), folder, schema, per_file)
    finally:
        spark.sql(f"drop table if exists {index}")
    return report(spark, folder, schema).withColumn("rewritten", F.col("day").isin(dirty) if dirty else F.lit(False))
