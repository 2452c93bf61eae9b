"""Line near-duplicates by a segment-partition edit join, in SQL functions only.

A line may differ from another by one edit for each ``EACH`` characters of the shorter, and by
``EDITS`` at most; lines too short for any edit are repeats only of equal ones. The shorter line is
split into one segment more than it has edits, of which at least one is left whole in the longer.
Each line is indexed by its segments, hashed with their number and the line's length; each line
probes the index with the substrings that can be a segment of a line as long or up to ``edits``
shorter, at the few places where one can lie. What meets is verified by edit distance, bit-parallel
in a band about the diagonal.

Pairs are never listed: a pair is looked at where it first meets, in blocks of a bounded number of
lines of one key, and adds to the two lines' numbers of links and to the links that span them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, listed, row_key

EDITS, EACH = 2, 10


def allowed(n: str, edits: int = EDITS) -> str:
    """SQL: the edits that a line of n characters may have from one as long or longer."""
    return f"least({edits}, {n} div {EACH})"


def _key(begin: str, length: str, k: str, n: str) -> str:
    """SQL: the hash of a piece of chars, the line in four bytes a character: those are cut without counting."""
    return f"xxhash64(substring(chars, cast(4 * ({begin}) + 1 as int), cast(4 * ({length}) as int)), {k}, {n})"


def _segment(n: str, k: str, parts: int) -> tuple[str, str]:
    """(begin, length) of the k-th of ``parts`` segments of a line of n characters; the last ones are longer by one."""
    return f"{k} * ({n} div {parts}) + greatest(0, {k} - {parts} + {n} % {parts})", f"{n} div {parts} + if({k} >= {parts} - {n} % {parts}, 1, 0)"


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(characters that the other line is shorter by, segment, move) of each substring to look up.

    Before segment k at most k edits can lie if it is the first that is whole, and after it at
    most edits - k, so its place moves by k at most, and by edits - k from where it is seen from the end.
    """
    return [(less, k, move) for less in range(edits + 1) for k in range(edits + 1) for move in range(max(-k, less - (edits - k)), min(k, less + edits - k) + 1)]


OWN = -1


def slots(edits: int = EDITS) -> list[tuple[int, str]]:
    """(characters shorter, SQL of a key) of all that a line is indexed by (``OWN``) or looks up; null where its length allows none.

    The places of a slot are those of the shorter line's edits: at most ``edits`` + 1 segments of
    the line itself, and of lines 0, 1, ... characters shorter what ``probes`` has.
    """
    out = []
    for less in (OWN, *range(edits + 1)):
        n = f"(n - {less})" if less > 0 else "n"
        places = {e: [(k, 0) for k in range(e + 1)] if less == OWN else [(k, move) for of, k, move in probes(e) if of == less] for e in range(max(1, less), edits + 1)}
        for at in range(max(map(len, places.values()))):
            arms = []
            for e in sorted(places, reverse=True):
                k, move = places[e][at] if at < len(places[e]) else (0, 0)
                begin, length = _segment(n, str(k), e + 1)
                arms.append(f"when n >= {EACH * e + max(less, 0)} then {_key(f'{begin} + {move}', length, str(k), n) if at < len(places[e]) else 'null'}")
            out.append((less, f"case {' '.join(arms)} end"))
    return out


def edit_distance(shorter: str, longer: str, edits: int = EDITS) -> str:
    """SQL: the edit distance of two arrays of characters where it is at most ``edits``, else some larger number.

    Bit b of a column's words stands for the row b - edits below the diagonal; the words move down
    with it. The number kept is that of the diagonal on which the last cell lies, so the arrays'
    lengths may differ by at most ``edits``.
    """
    full, delta = (1 << (2 * edits + 1)) - 1, f"(size({longer}) - size({shorter}))"
    same = " + ".join(f"if(get({shorter}, j - {edits - b}) = c, {1 << b}, 0)" for b in range(2 * edits + 1))
    start = f"named_struct('vp', {full & ~((1 << edits) - 1)}, 'vn', 0, 'd', {delta}, 'j', 0)"
    d0 = f"(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {full})"
    hp = f"(t.vn | ({full} & ~(d0 | t.vp)))"
    step = (
        f"named_struct('vp', ((d0 & t.vp) | ~(shiftrightunsigned(d0, 1) | {hp})) & {full}, 'vn', shiftrightunsigned(d0, 1) & {hp}, "
        f"'d', t.d + if(t.j >= {delta} and (shiftrightunsigned(d0, {edits} - {delta}) & 1) = 0, 1, 0), 'j', t.j + 1)"
    )
    columns = f"transform({longer}, (c, j) -> {same})"
    return f"aggregate({columns}, {start}, (s, x) -> aggregate(array({d0}), s, (t, d0) -> {step}), s -> s.d)"


def within(a: str, b: str, edits: int = EDITS, most: str | None = None, glance: int = 32) -> str:
    """SQL: whether the strings a and b, a not longer and by at most ``edits``, lie within ``most`` edits: SQL, ``edits`` at most, or ``edits``.

    First both beginnings and both ends are looked at: where their diagonal has gone beyond what
    the rest of the band can make up for, the pair is out.
    """
    chars = lambda x: f"regexp_extract_all({x}, '(?s).', 0)"
    both = lambda x, y: f"transform(array(named_struct('a', {chars(x)}, 'b', {chars(y)})), p -> {edit_distance('p.a', 'p.b', edits)})[0]"
    out = lambda x, y: f"{both(f'left({x}, {glance})', f'left({y}, {glance})')} > {3 * edits}"
    return f"case when {out(a, b)} then false when {out(f'reverse({a})', f'reverse({b})')} then false else {both(a, b)} <= {most or edits} end"


#: The letters whose numbers are compared, about the commonest of Latin scripts.
COUNTED = "etaoinshrd"


def letter_counts() -> str:
    """SQL: two bits for each counted letter: its number modulo 4 in Gray code.

    An edit changes these numbers by at most 2 in sum, so lines within e edits differ in at most 2 e bits.
    """
    letters = ", ".join(f"'{c}'" for c in COUNTED)
    # the Gray code of 0, 1, 2, 3 is 0, 1, 3, 2, looked up in 0x2310. A function over an array also keeps
    # the whole projection out of one compiled method, for which all its keys would be too long.
    number = "((octet_length(line) - octet_length(replace(line, c, ''))) & 3)"
    return f"aggregate(array({letters}), 0L, (s, c) -> shiftleft(s, 2) | (shiftright(8976, 4 * {number}) & 3))"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, n, h1, h2): every line, its length, and 128 bits of hash. A null text has no lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumns({"n": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (line, n, h2) with an array of keys in the order of ``slots``.

    A function over an array, here of h2, keeps a projection out of one compiled method, for which all keys are too long.
    """
    return lines.withColumn("chars", F.encode("line", "UTF-32")).withColumns({"h2": F.expr("transform(array(h2), x -> x)[0]"), "keys": F.expr(f"array({', '.join(key for _, key in slots(edits))})")}).drop("chars")


def shared_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h1, key, less) of lines that share the key with a different line, one of them as its own segment.

    Keys are made where a line is read; equal lines then become one, so common lines are one row in
    the join. A row leaves the join once, however many lines have its key.
    """
    of = [less for less, _ in slots(edits)]
    long = _keys(lines.where(F.col("n") >= EACH).select("h1", "h2", "line", "n"), edits)
    # numbers alone are aggregated without sorting
    unique = long.select("h1", "h2", *[F.get("keys", F.lit(k)).alias(f"k{k}") for k in range(len(of))]).groupBy("h1", "h2").agg(*[F.max(f"k{k}").alias(f"k{k}") for k in range(len(of))])
    rows = unique.select("h1", F.inline(F.array(*[F.struct(F.col(f"k{k}").alias("key"), F.lit(less).cast("tinyint").alias("less")) for k, less in enumerate(of)]))).where("key is not null")
    met = lambda a, b: a.alias("a").join(b.alias("b"), F.expr("a.key = b.key and a.h1 <> b.h1"), "left_semi").distinct()
    own = rows.where(F.col("less") == OWN)
    probe = met(rows.where(F.col("less") != OWN), own)
    return checkpointed(probe.unionByName(met(own, probe)))


def _blocks(shared: DataFrame, most: int) -> DataFrame:
    """(key, h1, less, a, b): the rows of each key dealt to pairs of blocks: own segments to block a, what looks them up to block b.

    A block has about ``most`` lines, so the pairs of a group are bounded however common its key is.
    """
    own = F.col("less") == OWN
    counts = shared.groupBy("key").agg(F.count(F.when(own, 1)).alias("own"), F.count(F.when(~own, 1)).alias("other"))
    many = F.ceil(F.col("own") / most).cast("int").alias("n_a"), F.ceil(F.col("other") / most).cast("int").alias("n_b")
    common = listed(counts.where((F.col("own") > most) | (F.col("other") > most)).select(F.col("key").alias("common"), *many))
    rows = shared.join(common, shared["key"] == common["common"], "left").withColumns({"n_a": F.coalesce("n_a", F.lit(1)), "n_b": F.coalesce("n_b", F.lit(1))})
    mine, all_ = lambda n: F.pmod(F.xxhash64("h1"), F.col(n)).cast("int"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = rows.withColumns({"as": F.when(own, F.array(mine("n_a"))).otherwise(all_("n_a")), "bs": F.when(own, all_("n_b")).otherwise(F.array(mine("n_b")))})
    return placed.select("key", "h1", "less", F.explode("as").alias("a"), "bs").select("key", "h1", "less", "a", F.explode("bs").alias("b"))


def _links(own: DataFrame, probe: DataFrame, edits: int, apart: Column | None = None) -> DataFrame:
    """(u, v, ...) ids of different lines within their edits, each pair once: at the first of the shorter one's segments where they meet."""
    u, v = own.select(F.struct(*own.columns).alias("u")), probe.select(F.struct(*probe.columns).alias("v"))
    meet = "u.key = v.key and u.a = v.a and u.b = v.b and u.id <> v.id"
    # lines of equal length meet both ways: one is enough
    likely = f"(v.less > 0 or u.id < v.id) and bit_count(u.counts ^ v.counts) <= 2 * {allowed('u.n', edits)} and not arrays_overlap(filter(slice(u.keys, 1, u.at), x -> x is not null), filter(v.keys, x -> x is not null))"
    met = u.join(v, F.expr(meet) if apart is None else F.expr(meet) & apart)
    return met.where(likely).where(within("u.line", "v.line", edits, allowed("u.n", edits)))


def line_links(lines: DataFrame, edits: int = EDITS, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, h1, h2, at; parts: id, part, n_links) of the different lines that links connect; part is the smallest id reachable.

    Texts are fetched for lines that share a key only. Links are counted as they are found, and the
    lines hooked to their lowest partner; what is found once more is only the links between what
    the hooks have connected.
    """
    shared = shared_keys(lines, edits)
    found = lines.join(listed(shared.select("h1").distinct()), "h1", "left_semi")
    texts = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.first("line").alias("line"))
    nodes = checkpointed(texts.withColumn("id", F.monotonically_increasing_id()))
    ready = _keys(nodes.withColumn("n", F.length("line")), edits).select("h1", "id", "line", "n", F.expr(letter_counts()).alias("counts"), "keys")
    placed = checkpointed(_blocks(shared, block).join(ready, "h1"))
    own = placed.where(F.col("less") == OWN).withColumn("at", (F.array_position("keys", F.col("key")) - 1).cast("int"))
    probe = placed.where(F.col("less") != OWN)
    ends = _links(own, probe, edits).select(F.inline(F.expr("array(struct(u.id as id, v.id as other), struct(v.id as id, u.id as other))")))
    hooked = checkpointed(ends.groupBy("id").agg(F.count("*").alias("n_links"), F.min("other").alias("low")))
    first = checkpointed(connected_components(hooked.select(F.col("id").alias("u"), F.col("low").alias("v"))).toDF("id", "part"))
    labelled = lambda side: side.join(first, "id")
    apart = _links(labelled(own), labelled(probe), edits, F.expr("u.part <> v.part")).selectExpr("u.part as u", "v.part as v").distinct()
    second = connected_components(apart).toDF("part", "whole")
    parts = hooked.join(first, "id").join(second, "part", "left").select("id", F.coalesce("whole", "part").alias("part"), "n_links")
    return nodes.select("id", "h1", "h2", "at"), parts


def near_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row for each line: doc_id, line_no (from 0), class_doc_id, class_line_no, n_copies, n_links, kept.

    Different lines are linked that lie within one edit for each ten characters of the shorter, and
    within ``edits`` at most; lines under ten characters are linked with nothing. Equal lines of any
    length, and lines that links connect, are a class: (class_doc_id, class_line_no) is its first
    line, n_copies the rows with exactly this line, n_links the different lines linked to it, and
    kept tells the class's first line. A null text has no rows, an empty one one empty line, of
    which there may be many copies. Texts and lines are read whole, however long. A null doc_id
    comes before all others. Documents that share a doc_id, or have none, are told apart by a hash of
    their texts, so one of them has the first line; rows that agree in doc_id and text are one document
    in this, and have it together. No documents: no rows.
    """
    own = F.struct("doc_id", F.xxhash64("text").alias("text"))
    rows = _near_lines(docs.select(own.alias("doc_id"), "text"), edits)
    return rows.withColumns({"doc_id": F.col("doc_id.doc_id"), "class_doc_id": F.col("class_doc_id.doc_id")})


def _near_lines(docs: DataFrame, edits: int) -> DataFrame:
    """``near_lines`` of documents whose doc_ids tell them apart and may be structs."""
    lines = lines_of(docs)
    nodes, parts = line_links(lines, edits)
    placed = checkpointed(nodes.join(parts, "id"))
    lowest = placed.groupBy("part").agg(F.min("at").alias("class"))
    linked = placed.join(lowest, "part").select("h1", "h2", "class", "n_links")
    lines = lines.select("doc_id", "line_no", "h1", "h2")
    copies = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_copies"), F.min(F.struct("doc_id", "line_no")).alias("at")).where("n_copies > 1")
    known = copies.join(linked, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("class", "at").alias("class"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    here = F.struct("doc_id", "line_no")
    rows = lines.join(known, ["h1", "h2"], "left").withColumn("class", F.coalesce("class", here))
    return rows.select(
        "doc_id", "line_no", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (here == F.col("class")).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` without the lines that are not the first of their class; every row and column stays.

    Blank lines part what is around them and say nothing themselves: they stay. A text all of whose
    lines go is empty; a null text stays null. n_chars, where there is such a column, is that of the
    new text. Texts that share a doc_id, or have none, are separate documents; only rows that agree
    in both are one, and so keep their lines alike. No rows: no rows.
    """
    place = row_key()
    keyed = docs.select(place.alias("doc_id"), "text")
    gone = _near_lines(keyed, edits).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")).withColumnRenamed("doc_id", "gone_id")
    whole = docs.select(place.alias("id"), F.struct(*docs.columns).alias("row"))
    joined = whole.join(gone, whole["id"] == gone["gone_id"], "left")
    text = F.expr("if(gone is null, row.text, array_join(filter(split(row.text, '\\n'), (x, i) -> x not rlike '\\\\S' or not array_contains(gone, i)), '\\n'))")
    new = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return joined.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
