"""Merkle manifest of a dataset, built and verified by supersteps over RDDs.

Each row is a leaf. The leaves of a group (lang), in order of doc_id, are the lowest level of its
tree: each run of two consecutive nodes becomes their parent, a last run of one as well, until one
node is left, the group's subroot. Subroots in order of their groups are the leaves of the tree above.

Vertices pass messages as in Pregel. A vertex is the ancestor some levels up, ten say, of a run of
2^10 consecutive nodes, so that a superstep climbs several levels. Upwards, nodes message their
vertex; one whose messages are all there hashes its part of the tree and forwards the digest. In the
reverse supersteps each vertex sends the siblings on the way from it to the root down to the
vertices below, and at last to its leaves, which fold them into a root and hold it against the true one.

Null groups come before all others, null doc_ids first in their group; rows that share a doc_id are
in order of their leaves, so equal rows are each a leaf and any of them may be the first. An empty
table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
#: How many levels a superstep climbs.
LEVELS = 10


def digest(text: bytes) -> bytes:
    """The lowercase hex SHA-256, as ASCII."""
    return hashlib.sha256(text).hexdigest().encode()


def encoded(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, shown: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang, leaf, shown): each row's digest, and that of the row with the values of ``shown`` in place of its own.

    ``shown`` is null where the two are equal. Texts are hashed whole, in the JVM; other columns than the five play no part.
    """
    of = lambda values: F.sha2(F.concat(*[encoded(values[c]) for c in FIELDS]), 256)
    own = {c: F.col(c) for c in FIELDS}
    rows = docs.select(*FIELDS)
    changed = of(own | shown) if shown else F.lit(None).cast("string")
    both = rows.select("doc_id", "lang", of(own).alias("leaf"), changed.alias("shown"))
    return both.withColumn("shown", F.when(F.col("shown") != F.col("leaf"), F.col("shown")))


def tampered() -> dict[str, Column]:
    """n_chars + 1 where 7 divides the CRC-32 of the decimal doc_id; a null stays, and so does the row of a null doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return {"n_chars": F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))}


def climb(nodes: list[bytes], whole: bool, levels: int = LEVELS) -> list[list[bytes]]:
    """A vertex's part of a tree, lowest level first: ``levels`` above ``nodes``, or up to a single node if they are the ``whole`` level."""
    out = [nodes]
    while len(out) <= levels and not (whole and len(out[-1]) == 1):
        low = out[-1]
        out.append([digest(b"".join(low[k : k + 2])) for k in range(0, len(low), 2)])
    return out


def way(tree: list[list[bytes]], at: int) -> bytes:
    """The way up from a node: for each level ``<`` or ``>`` and the sibling to the left or right, or ``=`` where there is none."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append(b"=" if other >= len(nodes) else (b"<" if other < at else b">") + nodes[other])
        at >>= 1
    return b"".join(out)


def siblings(path: bytes) -> list[tuple[bytes, bytes]]:
    """(mark, digest) of each level of a way."""
    out, k = [], 0
    while k < len(path):
        mark, k = path[k : k + 1], k + 1
        size = 0 if mark == b"=" else HEX
        out.append((mark, path[k : k + size]))
        k += size
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for mark, other in path:
        node = digest(other + node if mark == b"<" else node + other)
    return node


def numbered(rows: DataFrame, tasks: int) -> RDD:
    """RDD of (number of the group, index in it, doc_id, leaf, shown), in order.

    Rows are range-partitioned, so that a group of any size lies in many tasks. A partition tells how
    many groups it has and how many rows its first and last one: no more goes to the driver.
    """
    order = ("lang", "doc_id", "leaf")
    placed = checkpointed(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)).rdd

    def ends(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        first = last = None
        head = tail = groups = 0
        for row in rows:
            if not groups or row[1] != last:
                first, groups, tail, last = (first if groups else row[1]), groups + 1, 0, row[1]
            tail += 1
            head += groups == 1
        if groups:
            yield part, groups, first, head, last, tail

    begins: dict[int, tuple[int, int]] = {}  # by partition: number of its first group, rows of that before
    group, before, open_ = -1, 0, None
    for part, groups, first, head, last, tail in sorted(placed.mapPartitionsWithIndex(ends).collect(), key=lambda x: x[0]):
        if group < 0 or first != open_:
            group, before = group + 1, 0
        begins[part] = group, before
        group, before = group + groups - 1, tail if groups > 1 else before + head
        open_ = last

    def number(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        group, at = begins.get(part, (0, 0))
        last, any_ = None, False
        for doc_id, lang, leaf, shown in rows:
            if any_ and lang != last:
                group, at = group + 1, 0
            yield group, at, doc_id, leaf, shown
            last, at, any_ = lang, at + 1, True

    return placed.mapPartitionsWithIndex(number)


def runs(rows: Iterator[tuple], levels: int = LEVELS) -> Iterator[tuple]:
    """((group, vertex), (first index, doc_ids, leaves, shown leaves by place)) of consecutive rows that share a vertex."""
    key, start, ids, nodes, shown = None, 0, [], [], {}
    for group, at, doc_id, leaf, other in rows:
        if key != (group, at >> levels):
            if ids:
                yield key, (start, ids, b"".join(nodes), shown)
            key, start, ids, nodes, shown = (group, at >> levels), at, [], [], {}
        if other is not None:
            shown[len(ids)] = other.encode()
        ids.append(doc_id)
        nodes.append(leaf.encode())
    if ids:
        yield key, (start, ids, b"".join(nodes), shown)


def joined(pieces: Iterator[tuple]) -> tuple[list, list[bytes], dict[int, bytes]]:
    """(doc_ids, leaves, shown) of a vertex, from its pieces in any order."""
    ids, nodes, shown = [], [], {}
    for _, some, digests, others in sorted(pieces, key=lambda p: p[0]):
        shown |= {len(ids) + k: v for k, v in others.items()}
        ids += some
        nodes += [digests[k : k + HEX] for k in range(0, len(digests), HEX)]
    return ids, nodes, shown


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of leaves (as of ``leaves``): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    proof_sha256 is the digest of all siblings on the leaf's way to the root; folded_root is what the
    shown leaf (its own where there is none) and these siblings give, and verified tells whether that is root.
    A superstep climbs ``levels`` levels; a vertex holds two to this power of digests.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = numbered(rows.select("doc_id", "lang", "leaf", "shown"), tasks).mapPartitions(lambda rows: runs(rows, levels)).groupByKey(tasks).mapValues(joined)

    def forwarded(vertices: RDD, children) -> RDD:  # noqa: ANN001
        """What complete vertices send up: (key, digest). One that holds its whole level is the only one of its group."""
        return vertices.map(lambda x: (x[0], climb(children(x[1]), x[0][1] == 0, levels)[-1][0]))

    def gathered(nodes: RDD, step: int) -> RDD:
        """The vertices above nodes ((group, index), digest), each with the digests of its children in order."""
        sent = nodes.map(lambda x: ((x[0][0], x[0][1] >> levels), (x[0][1], x[1])))
        return sent.groupByKey(max(1, tasks >> (5 * step))).mapValues(lambda got: [d for _, d in sorted(got)])

    up: list[RDD] = []
    nodes = forwarded(lowest, lambda v: v[1]).cache()
    groups = nodes.filter(lambda x: x[0][1] == 0).count()
    while nodes.count() > groups:
        up.append(gathered(nodes, len(up) + 1))
        nodes = forwarded(up[-1], lambda v: v).cache()
    within = len(up)
    nodes = nodes.map(lambda x: ((-1, x[0][0]), x[1]))  # subroots are the nodes of the tree above, in order of their groups
    while True:
        up.append(gathered(nodes, len(up) + 1))
        nodes = forwarded(up[-1], lambda v: v).cache()
        if nodes.count() <= 1:
            break
    down = nodes.mapValues(lambda root: (b"", b"", root))  # (way up, subroot, root) of a vertex
    for step in reversed(range(len(up))):

        def send(x: tuple, last: bool = step == within) -> Iterator[tuple]:
            (group, vertex), (children, (path, subroot, root)) = x
            tree = climb(children, vertex == 0, levels)
            for k, node in enumerate(children):
                at = (vertex << levels) + k
                yield ((at, 0) if last else (group, at)), (way(tree, k) + path, node if last else subroot, root)

        down = up[step].join(down, up[step].getNumPartitions()).flatMap(send)

    def verify(x: tuple) -> Iterator[tuple]:
        (_, vertex), ((ids, nodes, shown), (path, subroot, root)) = x
        tree, above = climb(nodes, vertex == 0, levels), siblings(path)
        rest = b"".join(d for _, d in above)
        for k, (doc_id, leaf) in enumerate(zip(ids, nodes, strict=True)):
            own = siblings(way(tree, k))
            proof = digest(b"".join(d for _, d in own) + rest)
            folded = fold(fold(shown.get(k, leaf), own), above)
            yield doc_id, leaf.decode(), subroot.decode(), root.decode(), proof.decode(), folded.decode(), folded == root

    return spark.createDataFrame(lowest.join(down, tasks).flatMap(verify), MANIFEST, verifySchema=False)
