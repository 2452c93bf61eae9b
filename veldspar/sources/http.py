"""Documents behind URLs, fetched by the tasks of a data source."""

from __future__ import annotations

import http.client
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.parsers import format_of
from .files import extension, shared_folder

PIECE = 4096
#: What a server may answer now and not a little later.
PASSING = frozenset({408, 425, 429, 500, 502, 503, 504})


@dataclass(frozen=True)
class Fetched:
    """What became of one URL. status: ok, not_found or too_large; reason: why it is not ok."""

    content: bytes | None
    status: str
    reason: str | None
    attempts: int
    seconds: float


class _Failed(Exception):  # noqa: N818
    def __init__(self, reason: str, again: bool = False, status: str = "not_found", wait: float | None = None):
        super().__init__(reason)
        self.reason, self.again, self.status, self.wait = reason, again, status, wait


def _get(url: str, timeout: float, until: float, most: int | None) -> bytes:
    """The body of one GET, whole or not at all."""
    request = urllib.request.Request(url, headers={"User-Agent": "veldspar", "Accept-Encoding": "identity"})  # noqa: S310  the scheme was looked at
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
            if reply.status != 200:
                raise _Failed(f"status_{reply.status}", reply.status in PASSING)
            told = reply.headers.get("Content-Length")
            if most is not None and told and told.isdigit() and int(told) > most:
                raise _Failed("too_large", status="too_large")
            parts, size = [], 0
            while piece := reply.read1(PIECE):
                parts.append(piece)
                size += len(piece)
                if most is not None and size > most:
                    raise _Failed("too_large", status="too_large")
                if time.monotonic() > until:
                    raise _Failed("timeout")
            if told and told.isdigit() and not reply.chunked and size != int(told):
                raise _Failed("truncated", again=True)
            return b"".join(parts)
    except urllib.error.HTTPError as error:
        wait = error.headers.get("Retry-After") if error.headers else None
        raise _Failed(f"status_{error.code}", error.code in PASSING, wait=float(wait) if wait and wait.isdigit() else None) from None


def fetch(url: str | None, timeout: float = 20.0, most: int | None = None, attempts: int = 3, pause: float = 0.5) -> Fetched:
    """One document, or why there is none: whatever the URL or the server, nothing is raised.

    Only http and https are followed. ``timeout`` holds for all attempts together. What may pass (a
    body cut short, a lost connection, a busy server) is tried ``attempts`` times, after pauses that
    double and that differ by URL; a server that names a pause is waited for. With ``most``, a
    document of more bytes is too_large.
    """
    began = time.monotonic()
    until, tried = began + timeout, 0
    if not url or not url.lower().startswith(("http://", "https://")):
        return Fetched(None, "not_found", "bad_url", 0, 0.0)
    while True:
        tried += 1
        try:
            return Fetched(_get(url, max(0.05, until - time.monotonic()), until, most), "ok", None, tried, time.monotonic() - began)
        except _Failed as failed:
            found = failed
        except (http.client.InvalidURL, UnicodeError, ValueError):
            found = _Failed("bad_url")
        except http.client.IncompleteRead:
            found = _Failed("truncated", again=True)
        except http.client.HTTPException:
            found = _Failed("protocol", again=True)
        except TimeoutError:
            found = _Failed("timeout")
        except OSError as error:
            reason = getattr(error, "reason", error)
            found = _Failed("timeout") if isinstance(reason, TimeoutError) else _Failed("unknown_host") if isinstance(reason, socket.gaierror) else _Failed("connection", again=True)
        except Exception as error:  # noqa: BLE001  one URL never ends a job
            found = _Failed(type(error).__name__)
        wait = found.wait if found.wait is not None else pause * 2 ** (tried - 1) * (0.75 + zlib.crc32(f"{tried} {url}".encode("utf-8", "replace")) % 1000 / 2000)
        if not found.again or tried >= attempts or time.monotonic() + wait >= until:
            return Fetched(None, found.status, found.reason, tried, time.monotonic() - began)
        time.sleep(wait)


def host_of(url: str | None) -> str:
    """The host and port of a URL in lower case; empty where it has none that can be told."""
    try:
        return urllib.parse.urlsplit(url or "").netloc.rpartition("@")[2].lower()
    except ValueError:
        return ""


class Hosts:
    """Within a task: at least ``gap`` seconds between requests to a host, and none to one that failed ``patience`` times in a row."""

    def __init__(self, gap: float, patience: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.patience, self.clock, self.sleep = gap, patience, clock, sleep
        self.last: dict[str, float] = {}
        self.failed: dict[str, int] = {}

    def get(self, host: str, ask: Callable[[], Fetched]) -> Fetched:
        if self.failed.get(host, 0) >= self.patience:
            return Fetched(None, "not_found", "host_down", 0, 0.0)
        if (wait := self.last.get(host, -self.gap) + self.gap - self.clock()) > 0:
            self.sleep(wait)
        found = ask()
        self.last[host] = self.clock()
        self.failed[host] = self.failed.get(host, 0) + 1 if found.reason in ("timeout", "connection", "unknown_host") else 0
        return found


FETCHED = "request_id string, document_url string, content binary, fetch_status string, reason string, attempts int, seconds double"


@dataclass
class Lane(InputPartition):
    """Part of a plan: the files of one lane."""

    number: int
    folder: str


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.lanes = options["path"], int(options["lanes"])
        self.timeout, self.attempts, self.pause = float(options.get("timeout", 20)), int(options.get("attempts", 3)), float(options.get("pause", 0.5))
        self.most = int(options["most"]) if "most" in options else None
        self.gap, self.patience = float(options.get("gap", 0)), int(options.get("patience", 20))

    def partitions(self) -> list[Lane]:
        return [Lane(k, f"{self.folder}/lane={k}") for k in range(self.lanes)]

    def read(self, lane: Lane) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(lane.folder)
        hosts = Hosts(self.gap, self.patience)
        schema = [("request_id", pa.string()), ("document_url", pa.string()), ("content", pa.binary()), ("fetch_status", pa.string()), ("reason", pa.string()), ("attempts", pa.int32()), ("seconds", pa.float64())]
        for info in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if not info.base_name.endswith(".parquet"):
                continue
            with store.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(1000, columns=["request_id", "document_url"]):
                    for request, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # one document at a time
                        got = hosts.get(host_of(url), lambda url=url: fetch(url, self.timeout, self.most, self.attempts, self.pause))
                        row = (request, url, got.content, got.status, got.reason, got.attempts, got.seconds)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, schema, strict=True)], [n for n, _ in schema])


class HttpSource(DataSource):
    """``spark.read.format("veldspar_http")``: the documents of a plan that ``planned`` wrote.

    Options: path and lanes of the plan; timeout, attempts, pause, most as of ``fetch``; gap and patience as of ``Hosts``.
    """

    @classmethod
    def name(cls) -> str:
        return "veldspar_http"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema: object) -> HttpReader:
        return HttpReader(self.options)


def planned(requests: DataFrame, lanes: int, per_host: int) -> str:
    """Writes ``requests`` (request_id, document_url) as a plan, and returns its folder.

    A lane is what one task fetches. The requests of a host lie in ``per_host`` lanes at most, dealt by
    URL, so no more connections than that are open to it at once, and one that most URLs name is
    still spread over several tasks.
    """
    url = F.col("document_url")
    rest = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.element_at(F.split(F.coalesce(rest, F.lit("")), "@"), -1))
    lane = F.pmod(F.xxhash64(host, F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(per_host))), F.lit(lanes)).cast("int")
    folder = shared_folder(requests.sparkSession)
    rows = requests.select(F.col("request_id").cast("string"), url.cast("string").alias("document_url")).withColumn("lane", lane)
    rows.repartition("lane").write.partitionBy("lane").parquet(folder)
    return folder


def fetched(requests: DataFrame, timeout: float = 20.0, strict: bool = False, lanes: int | None = None, per_host: int = 4, **options: float) -> DataFrame:
    """``requests`` (request_id, document_url) with content, ext, format, fetch_status, reason, attempts and seconds.

    One row a request, whatever becomes of it: fetch_status is ok, not_found or too_large. A document is
    held whole in its task. A task that is run again fetches its lane again. ``lanes``: as many tasks as
    can run at once by default; ``options`` are those of ``HttpSource``.
    """
    spark = requests.sparkSession
    lanes = lanes or spark.sparkContext.defaultParallelism
    spark.dataSource.register(HttpSource)
    chosen = {k: str(v) for k, v in {"timeout": timeout, **options, "lanes": lanes, "path": planned(requests, lanes, per_host)}.items()}
    rows = spark.read.format("veldspar_http").options(**chosen).load()
    return rows.withColumn("ext", extension(F.col("document_url"))).withColumn("format", format_of(F.col("ext"), strict))


def rejects(rows: DataFrame) -> DataFrame:
    """(request_id, document_url, fetch_status, reason, attempts) of the requests that gave no document."""
    return rows.where(F.col("fetch_status") != "ok").select("request_id", "document_url", "fetch_status", "reason", "attempts")
