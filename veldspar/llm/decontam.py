"""Benchmark decontamination by a BM25 inverted index of test items and block-max WAND.

The items are the indexed side, and every passage of every document is a query: overlapping
windows, so wide that any item lies whole in one. Impacts are scaled so that every item that could
be verified scores 1 or more, and 1 is the threshold. A passage whose lists' maxima cannot reach it
is dropped, and so are ranges of items for which the lists' maxima there cannot. In those that are
left a cursor runs along the list of each of the passage's words: the lists' maxima give the pivot,
the first item that could reach the threshold, and the maxima of the blocks around it tell whether
it is scored or its block skipped. What reaches the threshold is verified by overlap of question and
answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, by_size, frugal, small_batches

WORDS = 5
HITS = "doc_id long, item_id long, score double, overlap double, word long"


def plain(word: str) -> str:
    """A word as it is compared: lower case, letters and digits only; empty for a mark."""
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


def tokens(text: str) -> list[str]:
    """The words of a text, cut and lower-cased as those of documents are."""
    lower = pc.utf8_lower(pa.scalar(text)).as_py()
    return [w for w in map(plain, (b.decode() for b in lower.encode().split())) if w]


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    return {tuple(ids[k : k + WORDS]) for k in range(len(ids) - WORDS + 1)} or ({tuple(ids)} if ids else set())


def runs(ids: list[int], n: int) -> set[tuple[int, ...]]:
    """All runs of n neighbouring words."""
    return {tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)}


END = 1 << 60
RANGES = 64


class Index:
    """Lists of (item's place, impact) by term, in order of places, with maxima by list, by range of items and by block of ``block`` postings."""

    def __init__(self, items: list[tuple[int, str, str]], least: float = 0.8, block: int = 8, k1: float = 1.2, b: float = 0.75):
        self.block, self.least = block, least
        words = [(i, tokens(q), tokens(a)) for i, q, a in sorted(items, key=lambda x: (x[0], x[1]))]
        words = [(i, q, a) for i, q, a in words if q]
        self.ids = [i for i, _, _ in words]
        self.terms: dict[str, int] = {}
        for _, q, a in words:
            for w in (*q, *a):
                self.terms.setdefault(w, len(self.terms))
        coded = [[self.terms[w] for w in q] for _, q, _ in words]
        self.shingles = [shingles(q) for q in coded]
        self.answers = [{self.terms[w] for w in a} for _, _, a in words]
        self.longest = max(map(len, coded), default=1)
        df = Counter(t for q in coded for t in set(q))
        mean = sum(map(len, coded)) / max(1, len(coded))
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.top = np.zeros(len(self.terms) + 1)  # the last is that of words in no item
        self.width = max(1, -(-len(coded) // RANGES))
        self.range_top = np.zeros((len(self.terms) + 1, RANGES), np.float32)
        for at, q in enumerate(coded):
            impact = {t: math.log(1 + (len(coded) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(q) / mean)) for t, n in Counter(q).items()}
            # 1 - least of the shingles can be missing, so at most as many words: those of most impact
            missing = int((1 - least) * len(self.shingles[at]) + 1e-9)
            reachable = sum(sorted(impact.values())[: max(1, len(impact) - missing)])
            for t, x in impact.items():
                share = x / reachable + 1e-12
                lists[t].append((at, share))
                self.top[t] = max(self.top[t], share)
                self.range_top[t, at // self.width] = max(self.range_top[t, at // self.width], share)
        # of each list: places with an end beyond all, impacts, and of each block the last place and the maximum
        self.lists = {t: ([*(at for at, _ in v), END], [x for _, x in v], *self._blocks(v)) for t, v in lists.items()}

    def _blocks(self, postings: list[tuple[int, float]]) -> tuple[list[int], list[float]]:
        parts = [postings[k : k + self.block] for k in range(0, len(postings), self.block)]
        return [part[-1][0] for part in parts], [max(x for _, x in part) for part in parts]

    def search(self, query: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """(item's place, score) of all items that score ``threshold`` or more for a passage's distinct terms."""
        least = threshold - 1e-9
        if not query:
            return []
        bounds = self.range_top[query].sum(axis=0)
        return [x for k in np.flatnonzero(bounds >= least - 1e-3).tolist() for x in self._wand(query, k, least)]

    def _wand(self, query: list[int], part: int, least: float) -> list[tuple[int, float]]:
        """(place, score) of the items of one range that score ``least`` or more."""
        begin, end = part * self.width, (part + 1) * self.width
        # a cursor is [place, position in the list, the list's maximum in the range, places, impacts, last places of blocks, maxima of blocks]
        cursors, tops = [], self.range_top[query, part]
        for k in np.flatnonzero(tops).tolist():
            held = self.lists[query[k]]
            at = bisect_left(held[0], begin)
            cursors.append([held[0][at], at, float(tops[k]) + 1e-6, *held])
        cursors.sort(key=itemgetter(0))
        found = []
        while cursors:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            here, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else END
            for c in cursors[: pivot + 1]:
                k = bisect_left(c[5], at)
                if k < len(c[5]):
                    here += c[6][k]
                    beyond = min(beyond, c[5][k] + 1)
            if here >= least:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    c[1] = bisect_left(c[3], at, c[1])
                    if c[3][c[1]] == at:
                        score += c[4][c[1]]
                        c[1] += 1
                    c[0] = c[3][c[1]]
                if score >= least:
                    found.append((at, score))
            else:  # no item before ``beyond`` can do it
                for c in cursors[: pivot + 1]:
                    c[1] = bisect_left(c[3], beyond, c[1])
                    c[0] = c[3][c[1]]
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort(key=itemgetter(0))
        return found

    def verified(self, passage: list[int], at: int) -> float:
        """Share of the item's shingles in the passage; 0 if too few, or if the answer's words are missing."""
        own = self.shingles[at]
        share = len(own & runs(passage, len(next(iter(own))))) / len(own)
        answer = self.answers[at]
        if share < self.least or (answer and len(answer & set(passage)) < self.least * len(answer)):
            return 0.0
        return share


def parts(text: str) -> tuple[str, str]:
    """(question with answer, answer) of an item that is one text: its last sentence is the answer."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    return text, sentences[-1] if len(sentences) > 1 else ""


def _indexes(items: DataFrame, shard_bytes: int) -> Iterator[Index]:
    """Indexes of about ``shard_bytes`` of items each, so that none outgrows a broadcast; null ids and texts are left out."""
    usable = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    shards = max(1, math.ceil((usable.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) / shard_bytes))
    for k in range(shards):
        rows = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).toLocalIterator()
        yield Index([(i, *parts(t)) for i, t in rows])


Hit = tuple[int, int, float, float, int]


def _finder(index: Index) -> Callable[[pa.Array], Iterator[list[Hit]]]:
    """A function that gives, for stretches of texts of 4 MB, the (row, item's place, score, overlap, word) of what they hold."""
    step, none = max(64, index.longest), len(index.terms)

    def place(word: str) -> int:
        found = index.terms.get(word)
        if found is None:
            if not word or word.isalnum():
                return none if word else -1
            word = plain(word)
            return index.terms.get(word, none) if word else -1
        return found

    def find(texts: pa.Array) -> Iterator[list[Hit]]:
        for begin, rows in by_size(texts, 4 << 20):
            words = pc.ascii_split_whitespace(pc.utf8_lower(texts.slice(begin, rows).fill_null("")))
            coded = words.flatten().dictionary_encode()
            term = np.fromiter(map(place, coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))[coded.indices.to_numpy()]
            offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
            marks = np.concatenate([[0], np.cumsum(term >= 0)])
            ends, term = marks[offsets], term[term >= 0]
            total = np.concatenate([[0.0], np.cumsum(index.top[term])])
            out: dict[tuple[int, int], Hit] = {}
            lengths = np.diff(ends)
            windows = np.maximum(1, -(-lengths // step) - 1)  # each of two steps, the last to the end
            doc = np.repeat(np.arange(rows), windows)
            first = ends[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * step
            last = np.minimum(first + 2 * step, ends[doc + 1])
            for w in np.flatnonzero(total[last] - total[first] >= 1 - 1e-9).tolist():
                passage = term[first[w] : last[w]].tolist()
                for at, score in index.search([t for t in set(passage) if t != none]):
                    overlap = index.verified(passage, at)
                    key = (begin + int(doc[w]), at)
                    if overlap and (key not in out or out[key][3] < overlap):
                        out[key] = (*key, score, overlap, int(first[w] - ends[doc[w]]))
            yield list(out.values())

    return find


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    small_batches(docs.sparkSession)
    index_of = broadcast(docs.sparkSession, index)

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        find, kinds = _finder(index), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for found in find(batch.column(1)):
                rows = [(doc_ids[row], index.ids[at], *rest) for row, at, *rest in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], [x.split()[0] for x in HITS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, HITS)


def contaminated(docs: DataFrame, items: DataFrame, shard_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, score, overlap, word) for every item that a document holds; no row for a clean document.

    An item is held if 0.8 of its five-word shingles (an item of fewer words: all its words in
    a row) and of its answer's words are in one passage, whatever the case and marks. word is where the best such
    passage begins, in words. Null and empty texts hold nothing, and a long one is searched whole, in
    slices of windows; rows that share a doc_id, or have none, give a row each, as do items that share
    an item_id. Items without an id or a text are left out. No documents or no items: no rows. Items
    may be any number: they are indexed in shards of about ``shard_bytes`` of text, one scan each.
    """
    found = [_scan(docs, index) for index in _indexes(items, shard_bytes)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def keep_clean(docs: DataFrame, items: DataFrame, shard_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no item, as ``contaminated`` tells it.

    Each row is decided where it is read: whatever else has its doc_id, or none, plays no part, and
    rows that repeat are decided alike. A null or empty text holds nothing, a long one is searched
    whole. No rows, or no items: all rows there are.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in _indexes(items, shard_bytes):
        index_of = broadcast(docs.sparkSession, index)

        @frugal
        def keep(batches: Iterator[pa.RecordBatch], index_of: Callable[[], Index] = index_of) -> Iterator[pa.RecordBatch]:
            find = _finder(index_of())
            for batch in batches:
                held = {row for found in find(batch.column(at)) for row, *_ in found}
                yield batch.filter(pa.array([row not in held for row in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
