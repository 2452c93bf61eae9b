"""Arrow columns looked at a few rows at a time, so that a task's Python holds few of them as objects."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession


def sliced(make: Callable, kind: pa.DataType, *columns: pa.Array, most: int = 64) -> pa.Array:
    """``make`` of each row's values, as an array of ``kind``."""
    n = len(columns[0])
    parts = [pa.array([make(*row) for row in zip(*(c.slice(at, most).to_pylist() for c in columns), strict=True)], kind) for at in range(0, n, most)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Batches that go to Python hold this many bytes (or one row), unless the session has set its own size: 10,000 vectors, the usual number, are 30 MB in each of a task's steps."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64m", "64MB", None):
        spark.conf.set(name, size)
