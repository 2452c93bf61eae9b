"""Sentences, and their packing into overlapping chunks.

Packing depends on order within a document, never across documents: it is a fold over the
document's own sentences, so no rows are exchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.slices import sliced
from ..functions.text import SPACE, strip


def sentences(text: Column) -> Column:
    """Parts between white space that follows a full stop, exclamation or question mark; stripped, none blank (K1)."""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?]){SPACE}+"), strip), lambda s: s != "")


def pack_sentences(parts: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of sentences (K2 to K5).

    Each sentence that still fits is added with a space. One that does not closes the chunk, and
    the next begins with the last ``overlap`` characters; one that does not fit even there is a
    chunk by itself.
    """
    out: list[str] = []
    carried, fresh = "", False
    tail = lambda s: s[len(s) - overlap :] if 0 < overlap < len(s) else s if overlap else ""
    for part in parts:
        if len(carried) + len(part) + 1 > size and fresh:
            out.append(carried.strip())
            carried, fresh = tail(carried), False
        if len(carried) + len(part) + 1 <= size:
            carried, fresh = f"{carried}{part} ", True
        else:
            out.append(part.strip())
            carried, fresh = tail(part), False
    if fresh:
        out.append(carried.strip())
    return out


def packed(parts: Column, size: int = 512, overlap: int = 50) -> Column:
    """The array of chunks of an array of sentences, batch by batch in Arrow."""

    @F.arrow_udf("array<string>")
    def pack(column):  # noqa: ANN001, ANN202
        import pyarrow as pa

        return sliced(lambda p: None if p is None else pack_sentences(p, size, overlap), pa.list_(pa.string()), column)

    return pack(parts)


def packed_native(parts: Column, size: int = 512, overlap: int = 50) -> Column:
    """The same as one SQL fold, without Python; takes about as long."""
    state = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("b"), F.lit(False).alias("fresh"))
    tail = (lambda s: F.right(s, F.lit(overlap))) if overlap > 0 else (lambda s: F.lit(""))

    def step(s: Column, x: Column) -> Column:
        make = lambda o, b, fresh: F.struct(o.alias("o"), b.alias("b"), F.lit(fresh).alias("fresh"))
        closed = F.concat(s["o"], F.array(strip(s["b"])))
        fits = lambda n: n + F.length(x) + 1 <= size
        return (
            F.when(fits(F.length(s["b"])), make(s["o"], F.concat(s["b"], x, F.lit(" ")), True))
            .when(s["fresh"] & fits(F.least(F.lit(overlap), F.length(s["b"]))), make(closed, F.concat(tail(s["b"]), x, F.lit(" ")), True))
            .when(s["fresh"], make(F.concat(closed, F.array(strip(x))), tail(x), False))
            .otherwise(make(F.concat(s["o"], F.array(strip(x))), tail(x), False))
        )

    return F.aggregate(parts, state, step, lambda s: F.when(s["fresh"], F.concat(s["o"], F.array(strip(s["b"])))).otherwise(s["o"]))


#: Characters of chunks that go back to Spark at a time.
SENT = 1 << 20


def chunks(docs: DataFrame, text: str = "cleaned", size: int = 512, overlap: int = 50, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``also``, chunk_index, text), one row a chunk (K7). Empty and null texts give none.

    Texts go to Python whole and are split there as ``sentences`` does; one document at a time is an object.
    """
    rows = docs.select("doc_id", *also, F.col(text).alias("text"))
    last = len(also) + 1
    names = ["doc_id", *also, "chunk_index", "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(r"(?<=[.!?])\s+").split

        def made(batch: pa.RecordBatch, of: list[int], index: list[int], out: list[str]) -> pa.RecordBatch:
            at = pa.array(of, pa.int32())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(last)), pa.array(index, pa.int32()), pa.array(out, pa.string())], names)

        for batch in batches:
            of, index, out, held = [], [], [], 0
            for row, value in enumerate(batch.column(last)):
                found = pack_sentences([p for x in split(value.as_py() or "") if (p := x.strip())], size, overlap)
                of += [row] * len(found)
                index += range(len(found))
                out += found
                held += sum(map(len, found))
                if held >= SENT:
                    yield made(batch, of, index, out)
                    of, index, out, held = [], [], [], 0
            if out:
                yield made(batch, of, index, out)

    return rows.mapInArrow(pack, StructType([*rows.schema.fields[:-1], StructField("chunk_index", IntegerType()), StructField("text", StringType())]))


# -- documents larger than a task -------------------------------------------------------------------


def placed(parts: DataFrame, block: int = 4096) -> DataFrame:
    """``parts`` (doc_id, i, part) with ``begin``: the characters before the part, each part counted with a space.

    A document is summed in blocks of parts, so that no task needs all of it; what is summed over a whole document is a row a block.
    """
    sized = parts.withColumn("block", F.floor(F.col("i") / block)).withColumn("n", F.length("part") + 1)
    sums = sized.groupBy("doc_id", "block").agg(F.sum("n").alias("all"))
    before = sums.select("doc_id", "block", F.coalesce(F.sum("all").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = sized.withColumn("within", within).withColumnRenamed("doc_id", "of").join(before.withColumnRenamed("block", "b"), F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("block") == F.col("b")))
    return joined.select("doc_id", "i", "part", "n", (F.col("before") + F.col("within")).alias("begin"))


def followers(parts: DataFrame, size: int, overlap: int, stretch: int = 1 << 20) -> DataFrame:
    """(doc_id, i, next, alone) for parts as of ``placed``: where the chunk after one that begins at i begins, as it is with a whole overlap before it.

    How far a chunk reaches is a window over the next ``size - overlap`` characters, so a document is
    looked at in stretches of characters, each with as many more from the next one.
    """
    room = size - overlap
    at = F.floor(F.col("begin") / stretch)
    ends = parts.groupBy("doc_id").agg((F.max("i") + 1).alias("i"), F.max(F.col("begin") + F.col("n")).alias("begin"))
    every = parts.select("doc_id", "i", "begin", "n").unionByName(ends.select("doc_id", "i", "begin", F.lit(None).cast("int").alias("n")))
    both = F.array_distinct(F.array(at, F.greatest(F.floor((F.col("begin") - room) / stretch), F.lit(0))))
    dealt = every.withColumn("own", at).withColumn("s", F.explode(both))
    reach = F.max("i").over(Window.partitionBy("doc_id", "s").orderBy("begin").rangeBetween(Window.currentRow, room))
    alone = F.col("n") > room
    return dealt.withColumn("far", reach).where("s = own and n is not null").select("doc_id", "i", F.when(alone, F.col("i") + 1).otherwise(F.col("far")).alias("next"), alone.alias("alone"))


BLOCK = 4096


def _exits(n: np.ndarray, first: bool, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """How a block of parts, of n characters each with a space, is left: (room left, chunks begun in it) for each room that it may be entered with.

    Entered are -1 (the next part begins a chunk) and 0 to ``size`` characters that the open chunk
    has left; a document's first block has but one entry, an empty chunk. Where a chunk ends depends
    only on where it begins, so exits are found from the block's end.
    """
    room, m = size - overlap, len(n)
    ends = np.concatenate([[0], np.cumsum(n)])
    far = (np.searchsorted(ends, ends[:-1] + room, "right") - 1).tolist()
    left, begun = [-1] * m, [1] * m
    for i in range(m - 1, -1, -1):
        j = far[i]
        if j == m > i:
            left[i] = room - int(ends[m] - ends[i])
        elif (j := max(j, i + 1)) < m:  # a part alone is a chunk
            left[i], begun[i] = left[j], begun[j] + 1
    entered = np.array([size] if first else range(-1, size + 1))
    at = np.maximum(np.searchsorted(ends, entered, "right") - 1, 0).tolist()
    own = [int(first and j > 0) for j in at]  # the chunk that a document begins with is its own
    return [left[j] if j < m else r - int(ends[m]) for j, r in zip(at, entered.tolist(), strict=True)], [k + (begun[j] if j < m else 0) for j, k in zip(at, own, strict=True)]


def _other(block: np.ndarray, i: np.ndarray, before: tuple[int, int]) -> np.ndarray:
    """Where rows sorted by document, block and i pass on to another block: i rises within one."""
    return (block != np.concatenate([before[:1], block[:-1]])) | (i <= np.concatenate([before[1:], i[:-1]]))


def _entries(known: DataFrame, write: Callable[[DataFrame], DataFrame], size: int, overlap: int, block: int) -> DataFrame:
    """(doc_id, block, left, number) for the blocks after a document's first one: the room left in the chunk that is open there (-1: none), and the number of the next one.

    Blocks are looked at each by itself, and what they do with a room is composed over a document: a row of ``size`` + 2 numbers a block.
    """
    long = write(known.where(F.col("i") >= block).select(F.col("doc_id").alias("of")).distinct())
    sizes = known.join(long, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("doc_id", F.expr(f"int(i div {block})").alias("block"), "i", "n")
    kind, names = known.schema["doc_id"], ["doc_id", "block", "left", "begun"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, at, before = [], None, 0, (-1, 0)  # the sizes of the open block, its doc_id and number; the last row's place

        def made(blocks: list[tuple]) -> pa.RecordBatch:
            lefts, begun = zip(*(_exits(np.concatenate(n), b == 0, size, overlap) for _, b, n in blocks), strict=True)
            lists = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([d for d, _, _ in blocks]), pa.array([b for _, b, _ in blocks], pa.int32()), pa.array(lefts, lists), pa.array(begun, lists)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            b, i, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            starts, done = np.flatnonzero(_other(b, i, before)).tolist(), []
            if held:
                held.append(n[: starts[0] if starts else len(n)])
            for start, end in zip(starts, [*starts[1:], len(n)], strict=False):
                if held:
                    done.append((now, at, held))
                held, now, at = [n[start:end]], batch.column(0).slice(start, 1), int(b[start])
            before = int(b[-1]), int(i[-1])
            if done:
                yield made(done)
        if held:
            yield made([(now, at, held)])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = number = 0
        for batch in batches:
            rows, out = [], []
            for row, (b, lefts, begun) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if b:
                    rows.append(row)
                    out.append((left, number))
                    left, number = lefts[left + 1], number + begun[left + 1]
                else:
                    left, number = lefts[0], begun[0]
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.int32())], ["doc_id", "block", "left", "number"])

    ints = [StructField(x, IntegerType()) for x in ("block", "left", "number")]
    lists = [StructField(x, ArrayType(IntegerType())) for x in ("left", "begun")]
    dealt = sizes.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "i")
    exits = dealt.mapInArrow(look, StructType([kind, ints[0], *lists]))
    return exits.repartition("doc_id").sortWithinPartitions("doc_id", "block").mapInArrow(follow, StructType([kind, *ints]))


def _cut(size: int, overlap: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chunks that begin in each block, of rows (doc_id, block, i, part, left, number) sorted by the first three.

    A block's rows are its entry (i is -1) unless it is a document's first, the last parts of the
    block before it, its own parts and the first ones of the next block.
    """
    room, names = size - overlap, ["doc_id", "chunk_index", "text"]
    tail = lambda s: s[-overlap:] if overlap else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, now, before = None, 0, -1, -1
        carried, fresh, mine, over, left, number = "", False, False, True, -1, 0
        for batch in batches:
            ids = batch.column(0) if held is None else pa.concat_arrays([held, batch.column(0)])
            of, index, out = [], [], []

            def add(text: str) -> None:
                of.append(at)
                index.append(number)
                out.append(text.strip())

            for row, (b, i, part, entered, of_entry) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True), int(held is not None)):
                if b != now or i <= before:
                    if fresh and mine:
                        add(carried)
                    at, now = row, b
                    carried, fresh, mine = "", False, not b
                    over = b > 0 and i >= 0  # nothing of its own: only the last parts of the block before
                    left, number = (entered, of_entry) if i < 0 else (size, 0)
                before = i
                if over or i < 0:
                    continue
                n = len(part) + 1
                if i < b * block:
                    carried = tail(carried + part + (" " if n <= room else ""))
                elif n <= left:
                    carried, left, fresh = f"{carried}{part} ", left - n, True
                else:
                    if fresh and mine:
                        add(carried)
                        number += 1
                    carried, fresh, mine, over = tail(carried), False, True, i >= (b + 1) * block
                    if over:
                        continue
                    if n <= room:
                        carried, left, fresh = f"{carried}{part} ", room - n, True
                    else:
                        add(part)
                        carried, left, number = tail(part), -1, number + 1
            if out:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int32())), pa.array(index, pa.int32()), pa.array(out, pa.string())], names)
            if len(ids):
                held, at = ids.slice(at, 1), 0
        if fresh and mine:
            yield pa.RecordBatch.from_arrays([held, pa.array([number], pa.int32()), pa.array([carried.strip()], pa.string())], names)

    return cut


def chunks_of_rows(parts: DataFrame, write: Callable[[DataFrame], DataFrame], size: int = 512, overlap: int = 50, block: int = BLOCK) -> DataFrame:
    """(doc_id, chunk_index, text): the chunks of ``packed``, of sentences that are rows (doc_id, i from 0, part), for documents of any length.

    Documents are cut into blocks of ``block`` sentences, or ``size`` if that is more, and each block
    gives the chunks that begin in it. What a block does depends on the chunk that is open where it
    begins, of which only the room left matters: so each later block is known for every such room,
    and one pass over a document's blocks tells with which it is entered. A block sees the next one's
    first sentences, where its last chunk may end, and the last ones before it, for the overlap. Texts
    are written once and shuffled once. No row, group or task holds a document. ``write`` makes a
    table of rows that are read more than once, such as ``files.written``. An overlap is at most half
    a chunk. Nulls in doc_id are one document.
    """
    if not 0 <= 2 * overlap < size:
        raise ValueError("an overlap is at most half a chunk")
    block = max(block, size)
    known = write(parts.select("doc_id", F.col("i").cast("long").alias("i"), "part", (F.length("part") + 1).alias("n")))
    blocks = f"filter(array(b, if(i % {block} < {size}, b - 1, -1), if(i % {block} >= {block - overlap}, b + 1, -1)), x -> x >= 0)"
    none = F.lit(None).cast("int")
    dealt = known.withColumn("b", F.expr(f"int(i div {block})")).select("doc_id", F.explode(F.expr(blocks)).alias("block"), "i", "part", none.alias("left"), none.alias("number"))
    entries = _entries(known, write, size, overlap, block).select("doc_id", "block", F.lit(-1).cast("long").alias("i"), F.lit(None).cast("string").alias("part"), "left", "number")
    rows = dealt.unionByName(entries).repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "i")
    return rows.mapInArrow(_cut(size, overlap, block), StructType([known.schema["doc_id"], StructField("chunk_index", IntegerType()), StructField("text", StringType())]))
