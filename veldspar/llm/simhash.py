"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are two halves of 32. Fingerprints at 3 or fewer differing bits differ by
at most 1 bit in one half at least. For each half the anchors are a covering code: the perfect
Hamming code of 31 bits beside the 32nd bit, whose covering radius is 1. A fingerprint is
replicated to every anchor within covering radius + threshold = 1 + 1 bits of its half, so that two
halves at distance 1 or less always meet at an anchor: the one nearest to either. All that meet at
an anchor are compared over the full 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, connected_components, frugal, listed, row_key, small_batches

LINK = 3


def _syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the positions 1..31 of the set bits among the low 31: 0 for a code word, else the bit to flip."""
    out = np.zeros(half.shape, np.uint64)
    for at in range(31):
        out ^= ((half >> np.uint64(at)) & np.uint64(1)) * np.uint64(at + 1)
    return out


def anchors_within_two(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the half, anchor) for every anchor at most 2 bits away from each 32-bit half."""
    half = half.astype(np.uint64)
    s = _syndrome(half)
    flip = lambda at: np.where(at > 0, np.uint64(1) << (np.maximum(at, 1) - np.uint64(1)).astype(np.uint64), np.uint64(0))
    rows, near = [np.arange(len(half))] * 2, [half ^ flip(s), half ^ flip(s) ^ np.uint64(1 << 31)]
    for at in range(1, 32):  # the pairs (at, at ^ s) of positions whose flips also give a code word
        other = s ^ np.uint64(at)
        keep = np.flatnonzero((s > 0) & (other > at))
        rows.append(keep)
        near.append(half[keep] ^ np.uint64(1 << (at - 1)) ^ flip(other[keep]))
    return np.concatenate(rows), np.concatenate(near)


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp long) of whole texts: bit set if it is set in over half of the 3-word shingles' XXH64.

    Null, empty and blank texts have fingerprint 0; fewer than three words give one shingle.
    With ``keyed``, the text's hashes t1 and t2 of the row key come along.
    """
    small_batches(docs.sparkSession)
    import xxhash

    @frugal
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for row in range(batch.num_rows):
                words = (as_bytes(batch.column(1).slice(row, 1))[0] or b"").lower().split()
                if not words:
                    continue
                counts, n = np.zeros(64, np.int64), max(1, len(words) - 2)
                for begin in range(0, n, 1 << 16):
                    part = words[begin : begin + (1 << 16) + 2]
                    text = b" ".join(part)
                    ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
                    begins, last = [0, *ends[:-1].tolist()], (ends - 1).tolist()
                    hashes = np.array([digest(text[a:b], 42) for a, b in zip(begins, last[2:], strict=False)] or [digest(text, 42)], np.uint64)
                    for at in range(0, len(hashes), 255):  # bits added up as bytes
                        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
                out[row] = np.bitwise_or.reduce(np.where(2 * counts > n, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", "t1", "t2"][: batch.num_columns])

    key = row_key()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([key["t1"].alias("t1"), key["t2"].alias("t2")] if keyed else []))
    return texts.mapInArrow(prints, "doc_id long, fp long" + ", t1 long, t2 long" * keyed)


def _replicas(prints: DataFrame) -> DataFrame:
    """(anchor long, fp): each fingerprint at all its anchors; bit 32 of the anchor tells the half."""

    @frugal
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for begin in range(0, len(fp), 20_000):
                part = fp[begin : begin + 20_000]
                for which in (0, 1):
                    rows, near = anchors_within_two((part >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF))
                    yield pa.RecordBatch.from_arrays([pa.array((near | np.uint64(which << 32)).view(np.int64)), pa.array(part[rows].view(np.int64))], ["anchor", "fp"])

    return prints.select("fp").mapInArrow(replicate, "anchor long, fp long")


def links_in_runs(keys: np.ndarray, fp: np.ndarray, most: int = LINK) -> list[tuple[int, int]]:
    """Links that span what is linked among equal neighbouring ``keys``: (smaller row, larger row).

    Rows i and i + s are compared for s = 1, 2, ... as long as any key reaches so far. Rows that
    are already connected give no further link, so a run of n rows gives n - 1 links at most.
    """
    parent = list(range(len(fp)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, left, label, shift = [], np.arange(len(fp)), np.arange(len(fp)), 1
    while len(left := left[left + shift < len(fp)]) and len(left := left[keys[left] == keys[left + shift]]):
        close = left[np.bitwise_count(fp[left] ^ fp[left + shift]) <= most]
        fresh = close[label[close] != label[close + shift]]
        for a in fresh.tolist():
            x, y = root(a), root(a + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, a + shift))
        if len(fresh):
            label = np.array([root(x) for x in range(len(fp))]) if shift < 64 or shift % 64 == 0 else label
        shift += 1
    return out


def _compare(sorted_rows: DataFrame) -> DataFrame:
    """Spanning links of each run of equal keys (columns key long, fp long), read as a stream.

    A batch is compared up to its last whole run; the unfinished run is carried to the next.
    """

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            found = np.array(links_in_runs(k, f), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(f[found[:, c]].view(np.int64)) for c in (0, 1)], ["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole > 20_000:
                yield links(keys[:whole], fp[:whole])
                keys, fp = keys[whole:], fp[whole:]
        yield links(keys, fp)

    return sorted_rows.mapInArrow(compare, "u long, v long")


def _parts(mask: int, number: int = 4) -> list[int]:
    """The bits of ``mask`` in ``number`` parts of neighbours, as masks."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [k * len(bits) // number for k in range(number + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _dealt(crowd: DataFrame) -> DataFrame:
    """(key, fp, left): each row of ``crowd`` four times, once for each part of the bits ``left``, which joins the key and leaves them."""

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, fps, masks = (c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns)
            for mask in np.unique(masks).tolist():
                rows = np.flatnonzero(masks == mask)
                for part in _parts(mask):
                    pairs = np.stack([keys[rows], fps[rows] & np.uint64(part)], 1)
                    made = np.array([xxhash.xxh64_intdigest(p.tobytes(), part) for p in pairs], np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(np.full(len(rows), mask & ~part, np.uint64).view(np.int64))], ["key", "fp", "left"])

    return crowd.select("key", "fp", "left").mapInArrow(deal, "key long, fp long, left long")


def fingerprint_links(prints: DataFrame, crowded: int = 2048, levels: int = 2) -> DataFrame:
    """Links (u, v) that connect whatever distinct fingerprints (column fp) lie within 3 bits of each other.

    An anchor with more than ``crowded`` fingerprints is dealt out again, losing nothing: halves
    that differ by at most 1 bit leave at most 3 to the other half, so one of four parts of its bits
    is equal, and that part joins the key. Four parts of the bits left do the same for keys that are
    still crowded. Those crowded after all ``levels`` are of near copies, which no bits tell apart:
    they are cut into blocks, and each pair of blocks is a key of its own. So no key has more than
    about twice ``crowded``, and every pair of a key is compared.
    """
    low, high = (1 << 32) - 1, -(1 << 32)  # the bits of the half that the anchor is not about
    rows = _replicas(prints).select(F.col("anchor").alias("key"), "fp", F.when(F.col("anchor") < F.lit(1 << 32), F.lit(high)).otherwise(F.lit(low)).cast("long").alias("left"))
    found = None
    for level in range(levels + 1):
        hot = checkpointed(rows.groupBy("key").count().where(F.col("count") > crowded).select(F.col("key").alias("hot"), F.ceil(F.col("count") / crowded).cast("int").alias("blocks")))
        if hot.isEmpty():
            hot = None
        calm = rows if hot is None else rows.join(hot, rows["key"] == hot["hot"], "left_anti")
        links = _runs_compared(calm)
        found = links if found is None else found.unionByName(links)
        if hot is None:
            return found
        crowd = rows.join(hot, rows["key"] == hot["hot"])
        if level < levels:
            rows = checkpointed(_dealt(crowd))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = crowd.withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return found.unionByName(_runs_compared(pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")))


def _runs_compared(rows: DataFrame) -> DataFrame:
    return _compare(rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    component_id is the smallest doc_id that links reach, null only where all doc_ids of a
    component are. Equal fingerprints count as one in the search, so large groups of copies are
    one row there. Null, empty and blank texts have fingerprint zero and are linked like others; long
    ones are read whole. Rows that share a doc_id are separate texts. No rows: no rows.
    """
    prints = checkpointed(fingerprints(docs))
    ids = _least_of_component(prints, F.col("doc_id")).withColumnRenamed("least", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _least_of_component(prints: DataFrame, value: Column) -> DataFrame:
    """(fp, least): the least ``value`` of the rows that links reach from each fingerprint."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(value).alias("least")))
    parts = connected_components(fingerprint_links(distinct))
    placed = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("least"))
    return placed.select("fp", "component").join(lowest, "component").select("fp", "least")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, a null one last; of rows that share doc_id and text, one.

    Different texts with one doc_id, or none, are separate documents: of those in one component, too, one stays.
    Null and empty texts are copies of one another; long ones are read whole. All columns stay. No rows: no rows.
    """
    prints = checkpointed(fingerprints(docs, keyed=True))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    rows = prints.join(_least_of_component(prints, place), "fp").select("doc_id", "t1", "t2", (place == F.col("least")).alias("kept"))
    found = checkpointed(rows.groupBy("doc_id", "t1", "t2").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")))
    gone = listed(found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("t1").alias("gone_t1"), F.col("t2").alias("gone_t2")))
    key = row_key()
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (key["t1"] == gone["gone_t1"]) & (key["t2"] == gone["gone_t2"]), "left_anti")
    return kept if found.where("kept and rows > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
