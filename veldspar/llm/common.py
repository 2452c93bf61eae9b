"""What the operators of this package share: the shared folder, checkpoints, row streams, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import pickle
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator
from functools import partial
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a session on one machine gets a temporary folder without that setting; a cluster needs it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="veldspar-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def listed(ids: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows of ids, to be joined: sent to all tasks if they are ``most`` or fewer by count (about 10 MB), else as they are."""
    ids = checkpointed(ids)
    return F.broadcast(ids) if ids.count() <= most else ids


def row_key() -> Column:
    """Tells documents apart, in the order of their doc_ids: doc_id, which may be null or shared, and 128 bits of hash of the text."""
    return F.struct("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Batches that go to Python hold this many bytes (or one row), unless the session has set its own size."""
    name, usual = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB", None)
    if spark.conf.get(name, None) in usual:
        spark.conf.set(name, size)


def broadcast(spark: SparkSession, model: object) -> Callable[[], object]:
    """Sends a model of bounded size once to each executor, by value; call the result there to get it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def int_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Binary values as arrays of 32-bit numbers, without copying them."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else [0]
        flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        out += [flat[a:b].view(np.int32) for a, b in zip(at, at[1:], strict=False)]
    return out


def give_back() -> None:
    """Memory that this Python process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(f: Batches | None = None, *, keeps: bool = False) -> Batches:
    """The same function over batches, which gives its memory back when it ends: workers live on for other tasks.

    What other functions have ``kept`` in the worker goes first, unless this one ``keeps`` something itself.
    """
    if f is None:
        return partial(frugal, keeps=keeps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            sys.modules.pop("veldspar_kept", None)
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def by_size(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of a column with at most ``most`` bytes, or one row each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    begin = total = 0
    for row, size in enumerate(sizes):
        if row > begin and total + size > most:
            yield begin, row - begin
            begin, total = row, 0
        total += size
    if sizes:
        yield begin, len(sizes) - begin


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave when this Python process was first asked for ``name``; tasks share their worker's."""
    store = sys.modules.setdefault("veldspar_kept", ModuleType("veldspar_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (u, v); component is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer change. Minima are
    aggregated before the shuffle and joined back, so a node with very many links is never gathered
    in one task: the join's large partitions can be split. Nodes may be of any type with an order.
    Null ends and self links are dropped. No edges: no rows.
    """
    higher, lower = "case when u > v then u else v end as u", "case when u > v then v else u end as v"
    now = checkpointed(edges.select("u", "v").where("u <> v").selectExpr(higher, lower).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        most = state[0]  # no step makes more edges of them
        now = few(now, most)
        lowest = now.select(F.inline(F.expr("array(struct(u, v), struct(v as u, u as v))"))).groupBy("u").agg(F.min("v").alias("m"))
        # written, as it is read twice: a round in one plan has it three times, each with the shuffles ahead of it, which the driver plans and runs at once
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(_sent(lowest, most), "u")
        large = checkpointed(few(turned.select(F.col("v").alias("u"), F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("v")).distinct(), most))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # the link to the lowest stays, the others move there
        moved = large.join(_sent(lowest, most), "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        following = checkpointed(few(moved.distinct(), most))
        after = _state(following)
        now = following
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = few(now, state[0]).select(F.inline(F.expr("array(struct(u as node, v as component), struct(v as node, v as component))")))
    return few(ends.distinct(), 2 * state[0])


#: Rows that one task takes at least, where their number is known, and edges whose minima are sent to all tasks.
ROWS = 10_000


def few(df: DataFrame, most: int) -> DataFrame:
    """The same rows, of which there are ``most`` at most, in a task for each ``ROWS``, or one for each core.

    A step on few rows in as many tasks as there are shuffle partitions costs the driver memory for each of them.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most // ROWS)))


def _sent(lowest: DataFrame, edges: int) -> DataFrame:
    """Minima of the ends of so many edges, to be joined: sent to all tasks if the edges are ``ROWS`` or fewer, else as they are."""
    return F.broadcast(few(lowest, 2 * edges)) if edges <= ROWS else lowest


def _state(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)"), F.expr("coalesce(bit_xor(xxhash64(v, u, 1)), 0)")).first()
    return tuple(row)
