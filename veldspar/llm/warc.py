"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by id: each shard is a range of ids of a fixed width, and a range with too
many records is split further by digest. A shard rolls over to a further file once one has reached a
compressed size. Headers and digests are made anew from the payload alone, so that the same
records give the same files, whatever the session's partitions. A file is written under a temporary
name and renamed when whole; the archive counts as written once its manifest is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, frugal, listed, small_batches

CRLF = b"\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # a fixed value: the namespace of URLs
DATE = "2000-01-01T00:00:00Z"  # records carry no date of their own
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, sha1: str, copy: int = 0) -> str:
    """Of the ``copy``-th record of a page with a payload of this SHA-1."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page {page_id} {sha1} {copy}')}>"


def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    return CRLF.join([first.encode(), *(f"{k}: {v}".encode() for k, v in lines)]) + CRLF + CRLF


def make_record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool | None = None) -> bytes:
    """A record: a response with its payload, or a ``revisit`` of the first record of page ``refers_to``, which may have no id."""
    sha1 = hashlib.sha1(payload)
    digest = "sha1:" + base64.b32encode(sha1.digest()).decode()
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    revisit = refers_to is not None if revisit is None else revisit
    block = http if revisit else http + payload
    address = "".join(c for c in (url or "") if c.isprintable()) or f"urn:page:{page_id}"
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, sha1.hexdigest(), copy)), ("WARC-Date", DATE), ("WARC-Target-URI", address),
        ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        lines += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers_to, sha1.hexdigest())), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(lines, "WARC/1.1") + block + CRLF + CRLF


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body; the block digest must hold."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    if warc["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() or rest[len(block) :] != CRLF + CRLF:
        raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
    head, _, body = block.partition(CRLF + CRLF)
    return warc, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), body


def compressed(data: bytes) -> bytes:
    """One gzip member; nothing in it but the data decides its bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream: object, piece: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an open file, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(piece):
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def _decisions(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of pages (page_id, digest, size) whose payload others share: refers_to is the largest such page_id.

    Only digests go through the shuffle, counted before it.
    """
    keys = pages.where(F.col("size") >= least_bytes).select("page_id", "digest")
    shared = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    return keys.join(shared, "digest").distinct()


def _shards(rows: DataFrame, keyed: DataFrame, most: int) -> DataFrame:
    """``rows`` (page_id, digest, ...) with shard and part: ranges of ids of equal width, as many as hold ``most`` records each on average.

    ``keyed`` has the same ids and digests, and is what is counted. A range with more than ``most`` records is split by digest into parts of about as many; null ids are a range of their own.
    """
    n, low, high = keyed.agg(F.count("page_id"), F.min("page_id"), F.max("page_id")).first()
    ranges = max(1, -(-n // most))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    shard = F.expr(f"coalesce(cast((cast(page_id as decimal(20)) - {low or 0}) div {width} as int), -1)")
    dealt = rows.withColumn("shard", shard)
    crowded = listed(keyed.select(shard.alias("shard")).groupBy("shard").count().where(F.col("count") > most).select(F.col("shard").alias("crowded"), F.ceil(F.col("count") / most).alias("parts")))
    joined = dealt.join(crowded, dealt["shard"] == crowded["crowded"], "left")
    return joined.withColumn("part", F.pmod(F.xxhash64("digest"), F.coalesce("parts", F.lit(1))).cast("int")).drop("crowded", "parts")


def write(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, least_bytes: int = 1000, shard_records: int = 10_000) -> DataFrame:
    """Writes ``pages`` (page_id, url, payload binary) as gzipped WARC files under ``folder``; returns the manifest.

    Of records with equal payloads of ``least_bytes`` or more, exactly one is the response: one with
    the largest page_id (a null one is the least), of several such rows the first by url. The others
    revisit it, so each payload is stored, whatever ids repeat; smaller ones are all responses. Null
    payloads are empty; long ones are held one at a time. ``folder`` is an URI of a file system that all
    executors reach. A repeated task writes the same bytes to the same names, so it may be lost and
    run again. The manifest is written last, as Parquet in ``folder``/manifest; then what lost
    attempts left under temporary names is removed. An empty table gives no files.
    """
    small_batches(pages.sparkSession)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    keyed = keyed.withColumn("digest", F.concat(F.sha1("payload"), F.sha2("payload", 256)))
    small = checkpointed(keyed.select("page_id", "digest", F.octet_length("payload").alias("size")))  # all but the writing needs no payloads
    decisions = checkpointed(_decisions(small, least_bytes))
    decided = decisions.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    both = decided.unionByName(keyed.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "payload"))
    ids = decisions.select("page_id", "digest").unionByName(small.select("page_id", "digest"))
    placed = _shards(both, ids, shard_records).select("shard", "part", "page_id", "digest", "kind", "refers_to", "url", "payload")
    ordered = placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "page_id", "digest", "kind", "url")

    @frugal
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        names = ["file", "records", "bytes", "sha256"]
        sink, at, records, size, sha = None, "", 0, 0, None
        shard_at, rolled, same, copies, refers_to, shared = None, 0, None, 0, None, False

        def close() -> pa.RecordBatch:
            sink.close()
            store.move(f"{top}/.{at}.{context.taskAttemptId()}.tmp", f"{top}/{at}")
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ([at], [records], [size], [sha.hexdigest()])], names)

        for batch in batches:
            for shard, part, page_id, digest, kind, target, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, part) != shard_at:
                    if sink is not None:
                        yield close()
                    sink, shard_at, rolled, same = None, (shard, part), 0, None
                if (page_id, digest) != same:
                    same, copies, refers_to, shared = (page_id, digest), 0, target, kind == 0
                if kind == 0:
                    continue
                # the rows of the page referred to are all decided alike: the first of them is the response
                revisit = shared and (refers_to != page_id or copies > 0)
                data = compressed(make_record(page_id, copies, url, payload, refers_to if revisit else None, revisit))
                copies += 1
                if sink is None:
                    at, records, size, sha = f"part-{shard + 1:06d}-{part:04d}-{rolled:04d}.warc.gz", 0, 0, hashlib.sha256()
                    rolled += 1
                    sink = store.open_output_stream(f"{top}/.{at}.{context.taskAttemptId()}.tmp", compression=None)
                sink.write(data)
                sha.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    fs_, top = fs.FileSystem.from_uri(folder)
    fs_.create_dir(top, recursive=True)
    ordered.mapInArrow(put, MANIFEST).write.parquet(f"{folder}/manifest")
    for left in fs_.get_file_info(fs.FileSelector(top)):
        if left.is_file and left.base_name.startswith(".part-") and left.base_name.endswith(".tmp"):
            fs_.delete_file(left.path)
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive whose manifest is there: payload_bytes and payload_digest are the full payload's.

    A response's payload is held against its digest; a file against its size. Files are dealt to tasks,
    and each is read as a stream, one record at a time, however long. Null page_ids stay null; a
    payload that was null is empty; records that repeat come each; an archive without files gives no rows.
    """

    @frugal
    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])
        number = lambda x: int(x) if x else None
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                seen = 0
                with store.open_input_stream(f"{top}/{file}", compression=None) as stream:
                    for data in members(stream):
                        warc, http, body = parse_record(data)
                        digest = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if warc["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{file}: a payload differs from its digest")
                        out.append((number(warc["X-Page-ID"]), int(http["Content-Length"]), digest, warc["WARC-Type"], number(warc.get("X-Refers-To-Page-ID")), warc["WARC-Target-URI"]))
                        seen += 1
                        if len(out) >= 5000:
                            yield batch_of(out)
                            out = []
                if seen != records:
                    raise ValueError(f"{file}: {seen} records, the manifest has {records}")
                yield batch_of(out)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return files.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(get, RECORDS)
