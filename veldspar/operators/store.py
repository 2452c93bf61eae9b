"""Collections of points: hash-bucketed, log-structured, read through snapshots."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import POINTS


def latest(points: DataFrame, keys: tuple[str, ...] = ("collection", "id"), version: str = "version") -> DataFrame:
    """One row a key, that of the highest version (V5). Ties: the greatest row.

    Rows are combined before the shuffle; of points that are bucketed by their keys, nothing is shuffled.
    """
    rest = [c for c in points.columns if c not in keys]
    top = F.max(F.struct(version, *[c for c in rest if c != version])).alias("top")
    return points.groupBy(*keys).agg(top).select(*keys, *[F.col("top")[c].alias(c) for c in rest])


def with_dimension(points: DataFrame, dimensions: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(points of that dimension, all others with a reason) (V7)."""
    fits = F.coalesce(F.size(vector) == dimensions, F.lit(False))
    return points.where(fits), points.where(~fits).withColumn("reason", F.lit("dimension"))


def merge_next(levels: list[int], fan: int) -> tuple[int, int] | None:
    """(first, end) of the newest versions that are to become one: ``fan`` of a level at the end of the list, which then are one of the next level."""
    if len(levels) < fan or len(set(levels[-fan:])) > 1:
        return None
    return len(levels) - fan, len(levels)


class Store:
    """Named collections under a folder that all executors reach.

    A collection's points are a table in Spark's catalog, partitioned by version and bucketed by key,
    whose files lie in the collection's folder; a session that does not know it yet declares it. A
    version is written once, to a folder of its own. What counts is told by the newest snapshot: a
    small file with the versions in order, made whole under another name and then renamed to the
    next number, which only one writer can do; the others look again and try the next. So what
    fails half-way, or is never published, is never read.

    Which version of a key is the newest is decided within its bucket, on keys alone, so reading
    shuffles nothing. ``fan`` versions of a level are merged into one of the next, as in a
    log-structured merge tree: after any number of writes there are few versions, and a point was
    rewritten a logarithm of times. Folders that a merge or a replacement made needless are deleted
    with the one after, so that readers of the last snapshot can end.
    """

    KEYS = ("doc_id", "id")

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8, fan: int = 8):
        self.spark, self.root, self.buckets, self.fan = spark, root.rstrip("/"), buckets, fan

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):  # noqa: ANN202
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    # -- snapshots --------------------------------------------------------------------------------

    def _now(self, name: str) -> tuple[int, dict | None]:
        """(number, content) of the newest snapshot; 0 and None before the first."""
        base, fs = self._path(f"{name}/snapshots"), self._fs(name)
        names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return 0, None
        stream = fs.open(self._path(f"{name}/snapshots/{number:012d}"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, number: int, state: dict) -> bool:
        """Makes ``state`` the snapshot of this number; False where there is one already."""
        jvm, fs = self.spark._jvm, self._fs(name)
        made, wanted = self._path(f"{name}/snapshots/.{uuid.uuid4().hex}"), self._path(f"{name}/snapshots/{number:012d}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, wanted, none)
        except Py4JJavaError as error:
            fs.delete(made, False)
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def _change(self, name: str, to: Callable[[dict | None], dict | None]) -> bool:
        """Publishes what ``to`` makes of the newest snapshot, of a newer one if another writer was first; False if it makes nothing of it."""
        while True:
            number, state = self._now(name)
            following = to(state)
            if following is None:
                return False
            if self._publish(name, number + 1, following):
                break
        for folder in (state or {}).get("needless", []):
            self._fs(name).delete(self._path(f"{name}/{folder}"), True)
        for old in range(max(1, number - 8), number - 2):
            self._fs(name).delete(self._path(f"{name}/snapshots/{old:012d}"), False)
        return True

    def _state(self, name: str) -> dict:
        state = self._now(name)[1]
        if state is None:
            raise ValueError(f"there is no collection {name}")
        return state

    def exists(self, name: str) -> bool:
        """Whether the collection was created (V1)."""
        return self._now(name)[1] is not None

    def drop(self, name: str) -> None:
        """Removes the collection with its points (V2)."""
        state = self._now(name)[1]
        if state:
            self.spark.sql(f"drop table if exists {self._name(name, state)}")
        self._fs(name).delete(self._path(name), True)

    def create(self, name: str, dimensions: int = 768, metric: str = "cosine", overwrite: bool = False) -> bool:
        """Creates an empty collection (V4). One that exists is kept (V3) unless ``overwrite``; False if it was kept."""

        def to(state: dict | None) -> dict | None:
            if state and not overwrite:
                return None
            old = [f"data/{state['data']}"] if state else []
            return {"dimensions": dimensions, "metric": metric, "buckets": self.buckets, "data": uuid.uuid4().hex, "schema": None, "versions": [], "batches": {}, "needless": old}

        return self._change(name, to)

    def about(self, name: str) -> dict:
        state = self._state(name)
        return {k: state[k] for k in ("dimensions", "metric")}

    def versions(self, name: str) -> list[str]:
        """Names of what the collection has, in order; versions that were merged have one name."""
        state = self._now(name)[1]
        return [v["name"] for v in state["versions"]] if state else []

    # -- versions ---------------------------------------------------------------------------------

    def _name(self, name: str, state: dict) -> str:
        return f"veldspar_{hashlib.sha256(f'{self.root}/{name}/{state["data"]}'.encode()).hexdigest()[:24]}"

    def _table(self, name: str, state: dict, schema: StructType) -> str:
        table = self._name(name, state)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(
            f"create table if not exists {table} ({columns}, _key string, _version string) using parquet options (partitionOverwriteMode 'dynamic') partitioned by (_version) "
            f"clustered by (_key) into {state['buckets']} buckets location '{self.root}/{name}/data/{state['data']}'"
        )
        return table

    def _add(self, name: str, state: dict, schema: StructType, rows: DataFrame) -> dict:
        """Writes rows (with _key, dealt to buckets) as a version that nothing refers to yet.

        The table's dynamic overwrite, of a partition that is new, stages each job's files in a folder of
        its own. Jobs that append share one, which the first to end deletes under the others.
        """
        folder = uuid.uuid4().hex
        columns = [f.name for f in schema.fields]
        rows.select(*columns, "_key", F.lit(folder).alias("_version")).write.insertInto(self._table(name, state, schema), overwrite=True)
        return {"folder": folder, "level": 0}

    def _newest(self, name: str, state: dict, versions: list[dict]) -> DataFrame:
        """The rows of these versions that none of a later one replaces, with _key, in their buckets."""
        schema = StructType.fromJson(json.loads(state["schema"]))
        table = self._table(name, state, schema)
        if self.spark.conf.get("spark.sql.hive.manageFilesourcePartitions", "true") == "true":  # what another session wrote is not in this one's catalog
            parts = " ".join(f"partition (_version = '{v['folder']}')" for v in versions)
            self.spark.sql(f"alter table {table} add if not exists {parts}")
        self.spark.catalog.refreshTable(table)
        rows = self.spark.table(table).where(F.col("_version").isin([v["folder"] for v in versions]))
        if len(versions) == 1:
            return rows.drop("_version")
        place = F.create_map(*[F.lit(x) for k, v in enumerate(versions) for x in (v["folder"], k)])
        numbered = rows.withColumn("_order", place[F.col("_version")])
        newest = numbered.groupBy("_key").agg(F.max("_order").alias("_last")).hint("shuffle_hash")
        return numbered.join(newest, "_key").where("_order >= _last").drop("_version", "_order", "_last")

    @staticmethod
    def _keyed(keys: tuple[str, ...]) -> Column:
        """A key that is never null and differs wherever one of the keys does."""
        return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})

    def _written(self, name: str, state: dict, points: DataFrame) -> tuple[dict, str]:
        """(a version of these points, one for each key, ties to the greatest row; the collection's schema)."""
        schema = StructType.fromJson(json.loads(state["schema"])) if state["schema"] else StructType([f for f in points.schema.fields])
        if more := set(points.columns) - {f.name for f in schema.fields}:
            raise ValueError(f"the collection has no {', '.join(sorted(more))}")
        for f in schema.fields:
            if f.name not in points.columns:
                points = points.withColumn(f.name, F.lit(None).cast(f.dataType))
        rest = [f.name for f in schema.fields if f.name not in self.KEYS]
        dealt = points.withColumn("_key", self._keyed(self.KEYS)).repartition(state["buckets"], "_key")
        single = dealt.groupBy("_key", *self.KEYS).agg(F.max(F.struct(*rest)).alias("top")).select(*self.KEYS, "_key", *[F.col("top")[c].alias(c) for c in rest])
        return self._add(name, state, schema, single), schema.json()

    def write(self, name: str, points: DataFrame, version: str, batch: int | None = None) -> None:
        """Adds points as a version of this name. Written again under a name that counts already, it changes nothing.

        ``batch``: the number of a stream's batch, whose name is the stream's; a batch no later than one that counts is one that is repeated.
        """
        label = version if batch is None else f"{version}-{batch}"
        counts = lambda s: label in [v["name"] for v in s["versions"]] or label in s["batches"] or (batch is not None and s["batches"].get(version, -1) >= batch)
        state = self._state(name)
        if counts(state):
            return
        made, schema = self._written(name, state, points)

        def to(now: dict | None) -> dict | None:
            if now is None or now["data"] != state["data"]:
                raise RuntimeError(f"{name} was created anew meanwhile")
            if counts(now):
                return None
            if now["schema"] not in (None, schema):
                raise ValueError("another writer gave the collection other columns")
            known = {version: batch} if batch is not None else {label: 0}
            return now | {"schema": schema, "versions": [*now["versions"], made | {"name": label}], "batches": now["batches"] | known, "needless": []}

        self._change(name, to)
        self.compact(name)

    def compact(self, name: str) -> int:
        """Merges versions until fewer than ``fan`` of a level stand at the end; returns how many merges there were."""
        merges = 0
        while True:
            state = self._state(name)
            run = merge_next([v["level"] for v in state["versions"]], self.fan)
            if run is None:
                return merges
            old = state["versions"][slice(*run)]
            made = self._add(name, state, StructType.fromJson(json.loads(state["schema"])), self._newest(name, state, old))
            made |= {"level": old[0]["level"] + 1, "name": old[-1]["name"]}

            def to(now: dict | None, old: list = old, made: dict = made, data: str = state["data"]) -> dict | None:
                at = next((k for k, v in enumerate(now["versions"]) if v == old[0]), None) if now and now["data"] == data else None
                if at is None or now["versions"][at : at + len(old)] != old:
                    return None  # another writer merged them
                following = [*now["versions"][:at], made, *now["versions"][at + len(old) :]]
                return now | {"versions": following, "needless": [f"data/{data}/_version={v['folder']}" for v in old]}

            merges += self._change(name, to)

    def upsert(self, name: str, points: DataFrame) -> DataFrame:
        """Adds points as a further version; one with the same key replaces older ones when read (V5). Returns those of a wrong dimension."""
        good, bad = with_dimension(points, self.about(name)["dimensions"])
        self.write(name, good, uuid.uuid4().hex)
        return bad

    def replace_all(self, name: str, points: DataFrame, dimensions: int = 768, metric: str = "cosine") -> DataFrame:
        """The collection anew with these points alone (V6), which may be read from it. Returns those of a wrong dimension.

        What it held counts until the new points are written whole; a write that fails changes nothing.
        """
        good, bad = with_dimension(points, dimensions)
        anew = {"dimensions": dimensions, "metric": metric, "buckets": self.buckets, "data": uuid.uuid4().hex, "schema": None, "batches": {}}
        made, schema = self._written(name, anew, good)

        def to(now: dict | None) -> dict:
            return anew | {"schema": schema, "versions": [made | {"name": uuid.uuid4().hex}], "needless": [f"data/{now['data']}"] if now else []}

        self._change(name, to)
        return bad

    def points(self, name: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
        """The points that hold now; of a collection without any, no rows."""
        state = self._now(name)[1]
        if not state or not state["versions"]:
            return self.spark.createDataFrame([], f"doc_id bigint, {POINTS}")
        if keys != self.KEYS:
            raise ValueError(f"points are kept by {', '.join(self.KEYS)}")
        return self._newest(name, state, state["versions"]).drop("_key")
