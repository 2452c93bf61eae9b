"""Late arrivals, fingerprints and Merkle manifests against brute-force versions."""

import datetime as dt
import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from veldspar.llm import fingerprint, late_overwrite, merkle, queries

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# -- late arrivals --------------------------------------------------------------------------------

EPOCH = dt.datetime(1970, 1, 1)
CUT = dt.datetime(2024, 3, 20)


def micros(t):
    return None if t is None else (t - EPOCH) // dt.timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def early(row):
    return row[5] is not None and row[5] < CUT


def least_null(x):
    return (x is not None, 0 if x is None else x)


def layout(rows, per_file):
    """({(day, file_no): rows}, {sale_id: row}) by dictionaries and sorting."""
    best = {}
    for r in rows:
        key = (least_null(micros(r[5])), least_null(r[1]), (r[2] is not None, r[2] or ""), least_null(r[3]), least_null(micros(r[4])), least_null(r[6]))
        if r[0] not in best or key > best[r[0]][0]:
            best[r[0]] = (key, r)
    days = {}
    for _, r in best.values():
        days.setdefault(day(r[4]), []).append(r)
    out = {}
    for d, of in days.items():
        of.sort(key=lambda r: (least_null(micros(r[4])), least_null(r[0])))
        out |= {(d, k // per_file): of[k : k + per_file] for k in range(0, len(of), per_file)}
    return out, {k: r for k, (_, r) in best.items()}


def overwritten(rows):
    """What the query returns, by (day, file_no)."""
    per_file, both = 1 + len(rows) // 1100, []
    for r in rows:
        both.append(r)
        h = None if r[0] is None else zlib.crc32(str(r[0]).encode())
        if h is not None and h % 3 == 0 and day(r[4]) % 4 == 0:
            later = lambda t, n: None if t is None else t + dt.timedelta(days=n)
            both.append((*r[:3], None if r[3] is None else r[3] + 1, later(r[4], h % 2), later(r[5], 1 + h % 97), r[6]))
    _, at_first = layout([r for r in both if early(r)], per_file)
    last, winners = layout(both, per_file)
    late = {k: r for k, r in winners.items() if not early(r)}
    dirty = {day(r[4]) for r in late.values()} | {day(at_first[k][4]) for k in late if k in at_first}
    said = lambda x: "" if x is None else str(x)
    out = {}
    for key, of in last.items():
        cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in of)
        crc = sum(zlib.crc32(f"{said(r[0])}:{said(micros(r[4]))}:{said(micros(r[5]))}".encode()) for r in of)
        out[key] = (len(of), cents, crc, hashlib.sha256(",".join(said(r[0]) for r in of).encode()).hexdigest(), key[0] in dirty)
    return out


def told(rows):
    return {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in rows}


def data_files(root):
    return {str(p): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and p.name[0] not in "._"}


def test_late_overwrite_whole(spark, small):
    rows = queries.op11_late_overwrite(spark, small).collect()
    sales = spark.read.parquet(f"{small}/sales.parquet").select(*late_overwrite.COLUMNS)
    assert told(rows) == overwritten([tuple(r) for r in sales.collect()])
    assert {r.columns for r in rows} == {",".join(late_overwrite.COLUMNS)}
    assert {r.path for r in rows} == set(data_files(rows[0].path.split("/day=")[0]))
    assert any(not r.rewritten for r in rows) and any(r.rewritten for r in rows)


def odd_sales():
    t = lambda *x: dt.datetime(2024, *x)
    rows = [(k, k % 3, "x", 1.5 * k, t(1, 1 + k % 9, k % 24), t(1, 20), None) for k in range(40)]
    rows += [(k, 1, "late", None, t(1, 2, 1), t(4, 1), 1) for k in (3, 4, 5, 100)]  # days lose rows and win some
    rows += [(200, 1, "alone", 2.0, t(2, 27), t(2, 28), 1), (200, 1, "moved", 2.0, t(2, 26), t(4, 2), 1)]  # a day that is left without rows, if no copy stands there
    rows += [(300, None, None, None, None, None, None), (301, 1, "a", 1.0, None, t(1, 5), 0), (301, 1, "never", 9.0, t(3, 1), None, 0)]
    rows += [(None, 1, "null", 1.0, t(1, 3), t(1, 4), 1), (None, 2, "later", 1.0, t(1, 6), t(1, 7), 1)]
    rows += [(400, 5, "tie", 1.0, t(1, 3, 5, 6), t(1, 4), 1), (400, 6, "tie", 1.0, t(1, 3, 5, 6), t(1, 4), 1), (400, 6, "tie", 1.0, t(1, 3, 5, 6), t(1, 4), 1)]
    rows += [(500, 1, "old", -3.005, dt.datetime(1969, 12, 30, 23, 59, 59, 999999), dt.datetime(1969, 12, 31), 1), (501, 1, "édé", 0.004, dt.datetime(9990, 1, 1, 23, 59, 59, 999999), t(1, 1), 1)]
    return rows


def test_late_overwrite_odd_rows(spark):
    rows = odd_sales()
    extra = spark.createDataFrame([(*r, 7, 8) for r in rows], SALES + ", day int, file_no int")
    assert told(late_overwrite.layouts(spark, extra).collect()) == overwritten(rows)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # times have no zone: the session's plays no part
        assert told(late_overwrite.layouts(spark, extra).collect()) == overwritten(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert late_overwrite.layouts(spark, extra.limit(0)).collect() == []
    nothing_late = [r for r in rows if early(r) and r[0] in range(0, 40, 7)]
    assert told(late_overwrite.layouts(spark, spark.createDataFrame(nothing_late, SALES)).collect()) == overwritten(nothing_late)


def test_late_overwrite_keeps_other_files(spark, tmp_path):
    rows = odd_sales()
    folder, sales = f"file://{tmp_path}/sales", spark.createDataFrame(rows, SALES)
    own, both = late_overwrite, late_overwrite.with_copies(sales)
    schema, is_early = both.select(*own.COLUMNS).schema, "coalesce(arrived_at < timestamp_ntz'2024-03-20 00:00:00', false)"
    own.start(both.where(is_early), folder, 3)
    first = data_files(tmp_path / "sales")
    index = own.build_index(spark, folder, schema, f"file://{tmp_path}/index", buckets=3)
    tags = own.tagged(both.where(f"not {is_early}"), spark.table(index))
    plan = tags._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 2  # of the late rows; the index stays in its buckets
    dirty = own.overwrite(spark, tags, folder, schema, 3)
    spark.sql(f"drop table {index}")
    last = data_files(tmp_path / "sales")
    of_day = lambda files, wanted: {p: b for p, b in files.items() if (int(p.split("/day=")[1].split("/")[0]) in dirty) == wanted}
    assert dirty and of_day(first, False) == of_day(last, False) and of_day(last, False)
    assert not set(of_day(first, True)) & set(of_day(last, True))
    assert len(last) == own.report(spark, folder, schema).count()
    # one sale_id has very many rows, one day has nearly all
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) sale_id", "1L client_id", "'s' status", "1D total", "timestamp_ntz'2024-01-03 00:00:00' sold_at", "timestamp_ntz'2024-01-04 00:00:00' + make_dt_interval(0, 0, 0, id) arrived_at", "1 priority")
    assert told(own.layouts(spark, hot).collect()) == overwritten([tuple(r) for r in hot.collect()])


# -- fingerprints ---------------------------------------------------------------------------------


def plain_digest(text, rank):
    """The digest by loops over windows, votes and bits."""
    data = text.ljust(fingerprint.WINDOW, b"\0") if text else b""
    windows = [data[k : k + fingerprint.WINDOW] for k in range(len(data) - fingerprint.WINDOW + 1)]
    most = round(fingerprint.WINDOW * math.log2(fingerprint.WINDOW) * 65536)
    entropy = [(most - sum(round(c * math.log2(c) * 65536) for c in Counter(w).values())) * 1000 // most for w in windows]
    ranked = [int(rank[e]) for e in entropy]
    votes, width = Counter(), fingerprint.STRETCH
    for a in range(-width + 1, len(windows)):
        some = [(ranked[k], k) for k in range(max(0, a), min(len(windows), a + width)) if ranked[k] < fingerprint.NEVER]
        if some:
            votes[min(some)[1]] += 1
    chosen = [k for k in sorted(votes) if votes[k] >= fingerprint.VOTES]
    chain = []
    for a in range(0, len(chosen), fingerprint.FEATURES):
        bits = np.zeros(fingerprint.BITS, np.uint8)
        for k in chosen[a : a + fingerprint.FEATURES]:
            h = 0x9E3779B97F4A7C15
            for word in (int.from_bytes(windows[k][i : i + 8], "little") for i in range(0, fingerprint.WINDOW, 8)):
                h ^= word
                for shift, factor in fingerprint.MIX:
                    h = (h ^ h >> shift) * factor % 2**64
                h ^= h >> 31
            for i in range(fingerprint.HASHES):
                bits[h >> 11 * i & 2047] = 1
        chain.append(np.packbits(bits))
    return entropy, np.array(chain, np.uint8).reshape(len(chain), fingerprint.BITS // 8)


def test_digests_by_hand(monkeypatch):
    rng = random.Random(5)
    texts = [b"", b"a", "é".encode(), b"a" * 700, b"short of a win", b"exactly sixteen!", bytes(range(256)) * 3] + [bytes(rng.choices(b"abcdefgh ijklmn\n", k=rng.randint(1, 900))) for _ in range(30)]
    texts += [b"".join(bytes(rng.choices(b"etaoin shrdlu", k=6)) for _ in range(1500))] * 2
    counts = np.zeros(1001, np.int64)
    for t in texts:
        entropy, _ = plain_digest(t, np.zeros(1001, np.int64))
        counts += np.bincount(entropy, minlength=1001)
    assert (fingerprint.counted(texts) == counts).all()
    rank = fingerprint.ranks(counts)
    expected = [plain_digest(t, rank)[1] for t in texts]
    for piece in (1 << 18, 1000):  # long texts in pieces give the same
        monkeypatch.setattr(fingerprint, "PIECE", piece)
        assert all(a.shape == b.shape and (a == b).all() for a, b in zip(fingerprint.digests(texts, rank), expected, strict=True))
    assert all((fingerprint.digest_of(fingerprint.text_of(d)) == d).all() for d in expected)
    xs, ys = expected, expected[1:] + expected[:1]
    assert fingerprint.likenesses(xs, ys) == pytest.approx([fingerprint.likeness(a, b) for a, b in zip(xs, ys, strict=True)])
    assert fingerprint.likenesses(xs, xs) == [1.0] * len(xs)
    assert fingerprint.likeness(expected[0], expected[5]) == 0.0  # one without features


def test_fingerprints_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rank = fingerprint.rarity(docs)
    got = {r.doc_id: r for r in queries.op12_fingerprints(spark, small).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    assert len(got) == len(rows)
    edits, nexts = [], []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        q, r = len(text) // 4, got[doc_id]
        edited = text[: len(text) - q] + after[:q]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if doc_id % 10 == 0:
            own, other, beside = (plain_digest(t.encode(), rank)[1] for t in (text, edited, after))
            assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.text_of(own), fingerprint.text_of(other))
            assert (r.near_edited, r.near_next) == pytest.approx((fingerprint.likeness(own, other), fingerprint.likeness(own, beside)))
        if len(text) >= 100:
            edits.append(r.near_edited)
            nexts.append(r.near_next)
    assert min(edits) > 0.3 and np.mean(edits) > 0.7 and np.mean(np.array(edits) > np.array(nexts)) > 0.98 and np.mean(nexts) < 0.05


def test_fingerprints_odd_rows(spark):
    long = "".join(random.Random(3).choices("abcdefgh ijkl\n", k=400_000))
    rows = [(5, None, "en"), (None, "no id", "en"), (None, "no id", "en"), (3, "", None), (3, "the same id, a text", "en"), (3, "the same id, 𝔸nother", "en"), (9, long, "de"), (11, long, "fr"), (10, "short", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tail string")
    rank = fingerprint.rarity(docs)
    got = fingerprint.compared(docs, rank).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((d is not None, d or 0, len(t or "")) for d, t, _ in rows)
    by_id = {r.doc_id: r for r in got if r.doc_id in (5, 9, 10, 11)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by_id[5].edited_sha256 == sha("") and by_id[5].near_edited == 1.0
    assert by_id[9].edited_sha256 == sha(long[:300_000] + "short") and by_id[10].edited_sha256 == sha("shor" + long[0])
    assert by_id[9].fingerprint == by_id[11].fingerprint and by_id[11].edited_sha256 == sha(long[:300_000] + "no id")  # the first of all follows the last
    assert len({r.fingerprint for r in got if r.doc_id is None}) == 1
    one = docs.where("doc_id = 10")
    assert [(r.edited_sha256, r.near_next) for r in fingerprint.compared(one, rank).collect()] == [(sha("shors"), 1.0)]
    assert fingerprint.compared(docs.limit(0), fingerprint.rarity(docs.limit(0))).count() == 0


# -- Merkle manifests -----------------------------------------------------------------------------


def H(text):  # noqa: N802
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def manifest(docs):
    """What the query returns, from lists."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, more=0: H("".join(map(said, (d[0], d[3], d[2], None if d[4] is None else d[4] + more, d[1]))))
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    for of in groups.values():
        of.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = [tree([leaf(d) for d in groups[g]]) for g in order]
    above = tree([t[-1][0] for t in below])
    out = []
    for g, name in enumerate(order):
        for i, d in enumerate(groups[name]):
            node, proof = leaf(d, int(d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0)), []
            for levels, at in ((below[g], i), (above, g)):
                for nodes in levels[:-1]:
                    both = [node, *nodes[(at ^ 1) : (at ^ 1) + 1]]
                    proof += both[1:]
                    node, at = H("".join(both if at % 2 == 0 else both[::-1])), at // 2
            root = above[-1][0]
            out.append((d[0], leaf(d), below[g][-1][0], root, H("".join(proof)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_whole(spark, small, levels):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = merkle.manifest(merkle.leaves(docs, merkle.tampered()), levels).collect()
    assert sorted(map(tuple, got), key=str) == manifest([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert {r.verified for r in got} == {True, False}


def test_manifest_odd_rows(spark):
    rows = [(k, f"text {k}", "en", "s", k) for k in range(17)] + [(k, "x" * 200_000, None, None, None) for k in (7, 14, 21)] + [(40, "é𝔸", "émile", "", 2), (41, None, "zz", "s", 0), (42, "", "zz", "s", 2**63 - 1)]
    rows += [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (3, "other", "en", "s", 1), (5, "text 5", "en", "s", 5), (5, "text 5", "en", "s", 5)] + [(100 + k, "t", f"l{k:02d}", "s", 1) for k in range(9)]
    docs = spark.createDataFrame([(*r, "leaf", "shown") for r in rows], DOCS + ", leaf string, shown string")
    for levels in (1, 2, 10):
        got = merkle.manifest(merkle.leaves(docs, merkle.tampered()), levels).collect()
        assert sorted(map(tuple, got), key=str) == manifest(rows)
    one = merkle.manifest(merkle.leaves(docs.where("doc_id = 40"))).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.verified, r.proof_sha256) for r in one] == [(True, True, H(""))]
    assert merkle.manifest(merkle.leaves(docs.limit(0))).collect() == []


def test_numbered_over_partitions(spark):
    rows = spark.range(500).selectExpr("id doc_id", "case when id < 5 then null when id < 400 then 'a' else cast(id div 3 as string) end lang", "cast(id as string) leaf", "cast(null as string) shown")
    found = sorted(merkle.numbered(rows, 7).map(lambda x: x[:3]).collect(), key=lambda x: x[:2])
    order = sorted(rows.collect(), key=lambda r: (r.lang is not None, r.lang or "", r.doc_id))
    names = list(dict.fromkeys(r.lang for r in order))
    seen, expected = Counter(), []
    for r in order:
        expected.append((names.index(r.lang), seen[r.lang], r.doc_id))
        seen[r.lang] += 1
    assert found == expected
