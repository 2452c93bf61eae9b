"""Packing of tokenised documents into sequences of fixed length.

First-fit decreasing on a tournament tree of bin capacities, run independently in randomised
groups of documents. A document is cut into full sequences and one remainder; the remainders of a
group are what the tree places.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, frugal, kept, small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Packed ids of words between ASCII white space, by a vocabulary whose words never cross it.

    `tokenizers` encodes each new word; one of Latin letters alone goes straight to the
    vocabulary's model, after the same lower-casing and byte alphabet. The words used last are
    kept, twice ``most`` of them, so memory is bounded whatever the corpus holds. Whether a
    vocabulary's words are so is tried on sentences of several scripts: where any of their ids
    differ, whole texts are given to the tokenizer instead.
    """

    TRIAL = ("", " ", "Two Words, and don't.", "ÀÉß ÿ× Øre Straße naïve", "x1 12ab 3.5 a-b a.b,", "汉字 日本語。 😀", "tab\tline\nfeed  two", "<|endoftext|> [CLS] <s>a</s>")

    LATIN = frozenset("abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7))

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.fresh: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        rest = iter(range(256, 512))
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
        self.letters = {ord(c): "".join(alphabet[b] for b in c.encode()) for c in self.LATIN}
        self.by_word = True
        ids, begins = self.encode(pa.array(self.TRIAL))
        self.by_word = all(ids[a:b].tolist() == e.ids for a, b, e in zip(begins, begins[1:], self.tokenizer.encode_batch(list(self.TRIAL), add_special_tokens=False), strict=False))

    def ids(self, word: str) -> bytes:
        found = self.fresh.get(word)
        if found is not None:
            return found
        found = self.older.get(word)
        if found is None:
            lower = word.lower()
            if len(lower) == len(word) and self.LATIN.issuperset(lower):
                ids = [t.id for t in self.tokenizer.model.tokenize(lower.translate(self.letters))]
            elif word[-1:] in (".", ",") and word[-2:-1].lower().isalpha():
                return self.ids(word[:-1]) + self.ids(word[-1])
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.fresh) >= self.most:
                self.older, self.fresh = self.fresh, {}
            self.fresh[word] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin (with the end of the last)."""
        texts = texts.fill_null("")
        if not self.by_word:
            whole = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *whole]), np.concatenate([[0], np.cumsum([len(x) for x in whole], dtype=np.int64)])
        marked = pc.match_substring(texts, "<|")  # special tokens are lower-case: others must stay as they are
        texts = pc.if_else(marked, texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        packed = [self.ids(w) if w else b"" for w in coded.dictionary.to_pylist()]
        store = np.frombuffer(b"".join(packed), np.uint32)
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        begins = np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy()
        counts = lengths[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(begins[index] - ends[:-1], counts) + np.arange(ends[-1])
        offsets = words.offsets.to_numpy()
        return store[at], ends[offsets - offsets[0]]


class FirstFit:
    """A tournament tree over bins in order of opening; each node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.capacity, self.room = capacity, [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length`` (at most the capacity), and the place in it."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < length:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= length
        bin_ = at - self.size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return bin_, offset


def pack_group(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """(bin, offset) of each length by first-fit decreasing (ties: in the order given), and the bins used."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, used = FirstFit(max(1, len(lengths)), capacity), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        placed[k] = tree.place(lengths[k])
        used = max(used, placed[k][0] + 1)
    return placed, used


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Each document's pieces: ``capacity`` ids each, and the remainder. A null text has the end id alone.

    Rows with the same doc_id are separate documents; other columns are not read.
    """
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    @frugal(keeps=True)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(f"words of {tokenizer}", lambda: WordIds(tokenizer))
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for begin, rows in by_size(batch.column(1), 4 << 20):
                out: list[tuple] = []
                ids, begins = words.encode(batch.column(1).slice(begin, rows))
                for k in range(rows):
                    whole = ids[begins[k] : begins[k + 1]].tobytes() + end
                    n = len(whole) // 4
                    for start in range(0, n, capacity):
                        part = whole[4 * start : 4 * (start + capacity)]
                        out.append((doc_ids[begin + k], start, len(part) // 4, zlib.crc32(part), n))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], PIECES.replace(" long", "").split(", "))

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group: int = 16_384) -> DataFrame:
    """Where each piece of each document lies: sequence_id, and offset without gaps from 0.

    Pieces are dealt at random (by a hash of what they are, so a task that is run again deals them
    alike in whatever order it reads) and packed in groups of at most ``group``, so a task holds one
    group, whatever the input; pieces that are equal in all are interchangeable. Nulls: a null text is empty, a null
    doc_id stays null. Long texts are cut into as many pieces as they need; rows that repeat, or
    share a doc_id, are documents of their own; pieces of equal length are placed in the order dealt.
    Other columns are not read. An empty table gives no rows. Every document gives at least one piece.
    """

    @frugal
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 40, []
        names = PLACED.replace(" long", "").split(", ")

        def packed(rows: list[tuple], base: int) -> tuple[pa.RecordBatch, int]:
            placed, used = pack_group([r[2] for r in rows], capacity)
            columns = list(zip(*rows, strict=True))[:5]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, [base + b for b, _ in placed], [o for _, o in placed])], names), base + used

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= group:
                out, base = packed(held[:group], base)
                held = held[group:]
                yield out
        if held:
            yield packed(held, base)[0]

    own = ("doc_id", "start", "ids_crc32", "doc_tokens")
    dealt = pieces(docs, tokenizer, capacity, end_id).withColumn("dealt", F.xxhash64(*own))
    return dealt.repartition(F.col("dealt")).sortWithinPartitions("dealt", *own).mapInArrow(place, PLACED)
