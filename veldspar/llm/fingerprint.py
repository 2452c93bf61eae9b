"""Document fingerprints: digests of the improbable features of a text.

The features of a text are its windows of WINDOW bytes. Each has an entropy, in thousandths of the
most it can have, and how rare that entropy is among all windows of the corpus ranks it: the rarest
first, what is too regular not at all. In each stretch of STRETCH neighbouring windows (shorter ones
at the ends of the text) the first of the rarest gets a vote, and a window with VOTES or more is
selected. Selected features go, in order, into a chain of Bloom filters of BITS bits, FEATURES
each, that set HASHES bits a feature. Two digests are compared filter by filter: the bits that two
filters share, less those that chance would give, over the most they could share.

A text shorter than a window is one window, filled up with zeros. A null text is empty; an empty one
has no features. Equal texts have equal fingerprints, whatever the rows around them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_size, frugal, small_batches

WINDOW, STRETCH, VOTES = 16, 32, 8
#: Entropies below this are too regular to tell texts apart.
LEAST = 200
BITS, FEATURES, HASHES = 2048, 160, 5
#: Bytes of text that are looked at together, so that they and what is made of them stay in a core's cache.
PIECE = 1 << 18
#: Multipliers and shifts of a 64-bit finaliser that is widely used.
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
NEVER = np.int64(1) << 40

_POINTS = np.arange(1, WINDOW + 1)
_WEIGHT = np.concatenate([[0], np.round(_POINTS * np.log2(_POINTS) * 65536)]).astype(np.int64)  # c log2 c, in whole numbers
_STEP = (_WEIGHT[1:] - _WEIGHT[:-1]).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Of the window at each place of ``data``, in thousandths of log2(WINDOW).

    As a window moves on, the sum of c log2 c over its bytes changes by the counts of the byte that leaves and the one that enters.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        before[d:] += same
        after[:-d] += same
    total = np.cumsum(_STEP[before])[WINDOW - 1 :]
    total[1:] -= np.cumsum(_STEP[after[: n - WINDOW]])
    most = int(_WEIGHT[WINDOW])
    return (most - total) * 1000 // most


class Pieces:
    """Texts laid out behind one another, with gaps that keep their windows apart; long texts in pieces that overlap."""

    def __init__(self, texts: list[bytes]):
        parts, self.text, self.first, self.begin, self.end, self.valid = [np.zeros(STRETCH, np.uint8)], [], [], [], [], []
        at = STRETCH
        for number, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            windows = max(len(data) - WINDOW + 1, min(len(data), 1))
            for a in range(0, windows, PIECE):
                low, high = max(0, a - STRETCH), min(windows, a + PIECE + STRETCH)
                own = data[low : high + WINDOW - 1]
                parts += [own, np.zeros(max(0, WINDOW - len(own)) + STRETCH, np.uint8)]
                self.text.append(number)
                self.first.append(at)
                self.valid.append(high - low)
                self.begin.append(at + a - low)
                self.end.append(at + min(windows, a + PIECE) - low)
                at += len(own) + len(parts[-1])
        self.data = np.concatenate([*parts, np.zeros(WINDOW, np.uint8)])
        self.first, self.valid, self.begin, self.end = (np.array(x, np.int64) for x in (self.first, self.valid, self.begin, self.end))

    def inside(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which places lie between begin and end of a piece."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    for begin, n in by_size(pa.array(texts, pa.binary()), PIECE):
        yield begin, texts[begin : begin + n]


def counted(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    out = np.zeros(1001, np.int64)
    for _, some in _groups(texts):
        pieces = Pieces(some)
        found = entropies(pieces.data)
        out += np.bincount(found[pieces.inside(pieces.begin, pieces.end)[: len(found)]], minlength=1001)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Of each entropy, the rarest first; of those that are as rare the lower. What is too regular or never seen comes last of all."""
    order = np.argsort(np.where(counts == 0, np.iinfo(np.int64).max, counts), kind="stable")
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts))
    out[:LEAST] = NEVER
    return out


def selected(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, window) of each selected feature, in order."""
    owners, windows = [], []
    for start, some in _groups(texts):
        pieces = Pieces(some)
        if not len(pieces.first):
            continue
        found = entropies(pieces.data)
        n = len(found)
        key = np.where(pieces.inside(pieces.first, pieces.first + pieces.valid)[:n], rank[found], NEVER)
        key = np.where(key < NEVER, key << 32 | np.arange(n), NEVER << 1)
        width = 1
        while width < STRETCH:  # the least of each stretch, by ever wider ones
            step = min(width, STRETCH - width)
            key, width = np.minimum(key[:-step], key[step:]), width + step
        chosen = (key & 0xFFFFFFFF)[key < NEVER << 1]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1, [len(chosen)]])
        at = chosen[edges[:-1]][np.diff(edges) >= VOTES] if len(chosen) else chosen
        at = at[pieces.inside(pieces.begin, pieces.end)[at]]
        owners.append(np.array(pieces.text, np.int64)[np.searchsorted(pieces.first, at, "right") - 1] + start)
        windows.append(np.lib.stride_tricks.sliding_window_view(pieces.data, WINDOW)[at])
    return np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(windows or [np.zeros((0, WINDOW), np.uint8)])


def hashed(windows: np.ndarray) -> np.ndarray:
    """HASHES places of bits of each window."""
    out = np.full(len(windows), 0x9E3779B97F4A7C15, np.uint64)
    for word in np.ascontiguousarray(windows).view("<u8").T:
        out ^= word
        for shift, factor in MIX:
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
        out ^= out >> np.uint64(31)
    return np.stack([(out >> np.uint64(11 * k)) & np.uint64(BITS - 1) for k in range(HASHES)], 1).astype(np.int64)


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Of each text its chain of filters, as rows of bytes."""
    owner, windows = selected(texts, rank)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    chain = -(-n // FEATURES)
    begin = np.cumsum(chain) - chain
    place = begin[owner] + (np.arange(len(owner)) - first[owner]) // FEATURES
    bits = np.zeros((int(chain.sum()), BITS), np.uint8)
    bits[place[:, None], hashed(windows)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + k] for a, k in zip(begin.tolist(), chain.tolist(), strict=True)]


def text_of(digest: np.ndarray) -> str:
    """A digest as a string: the number of its filters, a colon, and their bytes in base64."""
    return f"{len(digest)}:{base64.b64encode(digest.tobytes()).decode()}"


def digest_of(text: str) -> np.ndarray:
    n, _, data = text.partition(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), BITS // 8)


def _scores(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of filters with a and b bits that share some: what is beyond chance, over the most there could be. Three deviations of chance count as none."""
    chance = a * b / BITS
    spread = np.sqrt(chance * (1 - a / BITS) * (1 - b / BITS))
    most = np.minimum(a, b) - chance
    score = np.where((shared > chance + 3 * spread) & (most > 0), (shared - chance) / np.where(most > 0, most, 1), 0.0)
    return np.clip(score, 0.0, 1.0)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1 of two digests: of the shorter's filters the best score with any of the other's, weighted by their bits.

    Equal digests are alike by 1, also two without features; one without is like no other by 0.
    """
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    bits = [np.bitwise_count(d).sum(1).astype(np.float64) for d in (x, y)]
    best = np.zeros(len(x))
    for a in range(0, len(x), 256):  # blocks, so that very long chains need little memory
        left = np.unpackbits(x[a : a + 256], axis=1).astype(np.float32)
        for b in range(0, len(y), 256):
            shared = left @ np.unpackbits(y[b : b + 256], axis=1).astype(np.float32).T
            score = _scores(shared.astype(np.float64), bits[0][a : a + 256, None], bits[1][None, b : b + 256])
            best[a : a + 256] = np.maximum(best[a : a + 256], score.max(1))
    return float((best * bits[0]).sum() / bits[0].sum())


def likenesses(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[float]:
    """``likeness`` of each pair; pairs of single filters are compared together."""
    out = [0.0] * len(xs)
    single = [k for k, (x, y) in enumerate(zip(xs, ys, strict=True)) if len(x) == len(y) == 1]
    if single:
        a, b = (np.concatenate([d[k] for k in single]) for d in (xs, ys))
        n = [np.bitwise_count(d).sum(1).astype(np.float64) for d in (a, b)]
        score = np.where((a == b).all(1), 1.0, _scores(np.bitwise_count(a & b).sum(1).astype(np.float64), *n))
        for k, s in zip(single, score.tolist(), strict=True):
            out[k] = s
    for k in set(range(len(xs))) - set(single):
        out[k] = likeness(xs[k], ys[k])
    return out


# -- over a corpus --------------------------------------------------------------------------------


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of entropies, from all windows of all texts; 1,001 counts a task are summed before they go to the driver."""
    small_batches(docs.sparkSession)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, np.int64)
        for batch in batches:
            total += counted([t or b"" for t in as_bytes(batch.column(0))])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], ["entropy", "n"])

    found = docs.select("text").mapInArrow(count, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1001, np.int64)
    for entropy, n in found:
        counts[entropy] = n
    return ranks(counts)


def _key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tail) so that each row's successor in order of doc_id is the next row of its partition.

    Null doc_ids come first; texts that share a doc_id are in order of a hash. Ranges of the order are
    found from keys alone. The first row of each range is sent twice: as the ``tail`` behind the range
    before as well, and the first of all behind the last, so that no text but these is moved more than once.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    keys = docs.select(*_key())
    ranged = keys.repartitionByRange(tasks, "doc_id", "t1", "t2")
    heads = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "t1", "t2")).alias("head"))
    order = lambda h: (h[0] is not None, h[0] or 0, h[1], h[2])
    found = sorted({tuple(r["head"]) for r in heads.collect()}, key=order)
    rows = docs.select(*_key(), "text")
    if not found:
        return rows.select("doc_id", "text", F.lit(False).alias("tail"))
    n = len(found)
    known = F.array(*[F.struct(F.lit(d).cast(kind).alias("doc_id"), F.lit(a).alias("t1"), F.lit(b).alias("t2")) for d, a, b in found])
    own = F.struct("doc_id", "t1", "t2")
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    upto = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get("known", F.least(at + step, F.lit(n)) - 1) <= F.col("own")), at + step).otherwise(at))
    placed = rows.withColumns({"known": known, "own": own}).withColumn("part", F.greatest(upto - 1, F.lit(0)))
    is_head = F.get("known", F.col("part")).eqNullSafe(F.col("own"))
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("tail"))
    dealt = placed.select("doc_id", "t1", "t2", "text", F.inline(F.when(is_head, F.array(here, before)).otherwise(F.array(here))))
    return dealt.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("tail", "doc_id", "t1", "t2").select("doc_id", "text", "tail")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Each text's fingerprint beside that of its edited text, and how like it is to that and to the next document's.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all)
    of the next document, in ascending order of doc_id; after the last comes the first, so a single
    document follows itself. Rows that repeat follow one another. No rows give none.
    """
    small_batches(docs.sparkSession)

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for begin, n in by_size(batch.column(1), 4 * PIECE):
                part = batch.slice(begin, n)
                raw = [t or b"" for t in as_bytes(part.column(1))]
                own = digests(raw, rank)
                rows = held + list(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), [t.decode() for t in raw], own, strict=True))
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
                held = rows[-1:]
                edited = [(a[2][: len(a[2]) - len(a[2]) // 4] + b[2][: len(a[2]) // 4]).encode() for a, b in pairs]
                made = digests(edited, rank)
                mine = [a[3] for a, _ in pairs]
                columns = (
                    pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[2]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                    pa.array(map(text_of, mine), pa.string()), pa.array(map(text_of, made), pa.string()), pa.array(likenesses(mine, made), pa.float64()), pa.array(likenesses(mine, [b[3] for _, b in pairs]), pa.float64()),
                )
                yield pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in COMPARED.split(", ")])

    return with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(compare, COMPARED)
