"""Operators for training data: worked cases, brute force, and odd inputs of each."""

import base64
import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veldspar.llm import chat, common, decontam, embedding, language, line_dedup, packing, pii, quality, queries, simhash, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, ""), (2, None), (None, "a lone text without an id, long enough"), (3, "word " * 30_000), (4, "same text here for both of them, really"), (5, "same text here for both of them, really"), (5, "same text here for both of them, really"), (6, " \n\t\n "), (7, "汉字 😀 é́ İ")]


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns named as operators name theirs."""
    rows = [(i, t, "en" if i != 7 else None, "s", len(t or ""), 1, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h1 int, gone string").withColumns({n: F.lit(1) for n in ("fp", "key", "component", "found", "kept_id", "held_id", "line", "n_card", "score")})


def root_of(parent):
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return root


def components(n, links):
    parent = list(range(n))
    root = root_of(parent)
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# -- components ---------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_connected_components(spark, kind):
    n, r = 60, random.Random(4)
    links = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(40)], "none": []}[kind]
    names = r.sample(range(1000), n)
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame([(names[a], names[b]) for a, b in links], "u long, v long")).collect()}
    part = components(n, links)
    low = {p: min(names[i] for i in range(n) if part[i] == p) for p in part}
    assert got == {names[i]: low[part[i]] for i in range(n) if any(i in x and x[0] != x[1] for x in links)}


# -- 1 quality ----------------------------------------------------------------------------------


def test_dual_coordinate_descent_separates():
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(200, 12, replace=False)).astype(np.int32) + (300 if k % 2 else 0) for k in range(80)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(80)])
    values = [np.full(12, 12**-0.5)] * 80
    w, bias = quality.dual_coordinate_descent(rows, values, y, np.full(80, 10.0), epochs=200, tolerance=1e-4)
    margin = np.array([w[a] @ v + bias for a, v in zip(rows, values, strict=True)])
    assert (margin * y > 0).all()
    # at the optimum the gap between primal and dual is nil; the dual is bounded by the primal of these weights
    assert 0.5 * (w @ w + bias**2) + 10 * np.maximum(0, 1 - y * margin).sum() < 80 * 10


def test_indicators_do_not_depend_on_blocks(monkeypatch):
    text = ("ab cd ab cd ef " * 40).encode()
    whole = quality.Indicators()(text)
    monkeypatch.setattr(quality, "BLOCK", 64)
    assert (quality.Indicators()(text) == whole).all()


def test_log_count_ratios():
    ratio = quality.log_count_ratios([np.array([1]), np.array([1, 2]), np.array([2])], np.array([1, 1, -1]))
    assert ratio[1] > ratio[2] and ratio[1] > ratio[3]


def indicators_by_hand(text):
    """Features as (kind, value): byte 1-4-grams; words and pairs; repeated pairs."""
    b = text.encode()
    words = b.lower().split()
    same = sum(x == y for x, y in zip(words, words[1:], strict=False))
    found = {b[k : k + n] for n in range(1, 5) for k in range(len(b) - n + 1)} | {("w", w) for w in words} | {("p", *p) for p in zip(words, words[1:], strict=False)}
    return found | {("r", s) for s in quality.REPEATS if same > s * len(words)}


def test_quality_by_hand():
    """From texts to scores without the operator's own steps: the same sets, ratios and margin."""
    texts = ["good clean words here", "good words, clean", "spam spam spam spam", "buy spam now now", "clean here"]
    find = quality.Indicators()
    rows, sets = [find(t.encode()) for t in texts], [indicators_by_hand(t) for t in texts]
    assert [len(r) for r in rows] == [len(x) for x in sets]
    assert all(len(set(rows[a].tolist()) & set(rows[b].tolist())) == len(sets[a] & sets[b]) for a in range(5) for b in range(5))
    y = np.array([1, 1, -1, -1, 1])
    ratio = quality.log_count_ratios(rows, y)
    total = {s: quality.FEATURES + sum(len(x) for x, v in zip(sets, y, strict=True) if v == s) for s in (1, -1)}
    for k, x in enumerate(sets):
        have = lambda f, s: 1 + sum(f in z for z, v in zip(sets, y, strict=True) if v == s)
        assert np.isclose(sum(np.log(have(f, 1) / total[1]) - np.log(have(f, -1) / total[-1]) for f in x), ratio[rows[k]].sum())
    model = quality.fit(rows, [1, 1, 0, 0, 1])
    values, floor = quality._scaled(rows, ratio, 0.25)
    norms = np.sqrt([sum(ratio[r] ** 2) + floor for r in rows])
    assert all(np.allclose(v, ratio[r] / n, atol=1e-5) for v, r, n in zip(values, rows, norms, strict=True))
    weigh = np.where(y > 0, 5 / 6, 5 / 4)
    w, bias = quality.dual_coordinate_descent(rows, values, y.astype(float), weigh)
    for r, v in zip(rows, values, strict=True):
        margin = w[r] @ v + bias
        assert np.isclose(model.margin(r), margin, atol=1e-3)
        assert np.isclose(model.score(r), 1 / (1 + np.exp(-(model.slope * margin + model.shift))), atol=1e-3)
    # the optimum of the same problem by plain projected ascent on the dual
    q = np.array([[sum(dict(zip(rows[a].tolist(), values[a].tolist(), strict=True)).get(f, 0) * x for f, x in zip(rows[b].tolist(), values[b].tolist(), strict=True)) + 1 for b in range(5)] for a in range(5)]) * np.outer(y, y)
    alpha = np.zeros(5)
    for _ in range(20_000):
        alpha = np.clip(alpha + 0.05 * (1 - q @ alpha), 0, weigh)
    fine, _ = quality.dual_coordinate_descent(rows, values, y.astype(float), weigh, epochs=500, tolerance=1e-6)
    plain = np.zeros(quality.FEATURES)
    for a in range(5):
        plain[rows[a]] += alpha[a] * y[a] * values[a]
    assert np.allclose(fine, plain, atol=1e-3)


def test_models_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(k % 20, f"text {k} of {'good' if k % 2 else 'bad'} words", "en" if k % 2 else "fr") for k in range(60)], "doc_id long, text string, lang string").withColumns({"learned": F.lit(1), "order": F.lit(1), "turn": F.lit(1), "label": F.lit(1)})
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    a, b = (quality.train_model(docs.repartition(n, *c), labels) for n, c in ((1, ()), (5, ("text",))))
    assert (a.weight == b.weight).all() and (a.slope, a.shift) == (b.slope, b.shift)
    assert quality.train_model(docs, labels, most_bytes=2000).weight.any()
    a, b = (language.train_model(docs.repartition(n, *c)) for n, c in ((1, ()), (5, ("text",))))
    assert (a.weights == b.weights).all() and (a.place == b.place).all()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").join(got, "doc_id").where("held_out").collect()
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect()} == {True}
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    assert np.mean([r.quality == r.predicted for r in labels]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in labels)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train_model(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(dict(ODD[:2])[r.doc_id] if r.doc_id in (1, 2) else r.doc_id, set()).add(r.score)
    assert by_text[""] == by_text[None]
    assert quality.score(odd.limit(0), model).count() == 0
    assert quality.train_model(odd.limit(0), labels).score(np.zeros(0, np.int32)) == 0.5
    assert quality.keep_good(odd, model).columns == odd.columns


# -- 2 lines ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        at = r.randrange(len(text))
        kind = r.randrange(3)
        if kind == 0:
            text.insert(at, r.choice("abé😀"))
        elif kind == 1:
            del text[at]
        else:
            text[at] = r.choice("abé😀")
    return "".join(text)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    r = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abé😀") for _ in range(r.randint(4, 60)))
        a, b = sorted((a, edited(r, a, r.randint(0, 5))), key=len)
        if len(b) - len(a) <= edits:
            pairs.append((a, b, distance(a, b) <= edits))
    rows = spark.createDataFrame(pairs, "a string, b string, near boolean").select("near", F.expr(line_dedup.within("a", "b", edits)).alias("got")).collect()
    assert all(x.near == x.got for x in rows)


def lines_by_hand(docs):
    """{(doc_id, line_no): (class, copies, links, kept)} by comparing all lines with all."""
    occurs = {}
    for d, t in docs:
        for k, line in enumerate(t.split("\n")):
            occurs.setdefault(line, []).append((d, k))
    lines = sorted(occurs, key=lambda x: min(occurs[x]))
    near = lambda x, y: abs(len(x) - len(y)) <= min(2, min(len(x), len(y)) // 10) and distance(x, y) <= min(2, min(len(x), len(y)) // 10)
    links = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if near(lines[a], lines[b])]
    part = components(len(lines), links)
    expected = {}
    for i, x in enumerate(lines):
        first = min(occurs[lines[part[i]]])
        for o in occurs[x]:
            expected[o] = (first, len(occurs[x]), sum(i in p for p in links), o == first)
    assert links
    return expected


def lines_found(spark, docs, **options):
    rows = line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    return {(x.doc_id, x.line_no): ((x.class_doc_id, x.class_line_no), x.n_copies, x.n_links, x.kept) for x in rows}


def test_near_lines(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(20, 50))) for _ in range(40)]
    brief = ["".join(r.choice("ab") for _ in range(r.randint(1, 22))) for _ in range(80)]
    lines = [edited(r, b, r.randint(0, 4)) for b in base for _ in range(5)] + base + brief + [edited(r, b, 1) for b in brief] + ["short", "short", "", "", " ", "a" * 20, "a" * 21, "a" * 22, "a" * 9, "a" * 10, "a" * 11]
    r.shuffle(lines)
    docs = [(k // 10, "\n".join(lines[k : k + 10])) for k in range(0, len(lines), 10)]
    assert lines_found(spark, docs) == lines_by_hand(docs)


def test_common_segments_are_dealt_to_blocks(spark, monkeypatch):
    r = random.Random(10)
    lines = [f"Chapter {k} of the book about gardens and harbours" for k in range(60)] + [f"{r.choice('abc')} of the book about gardens and harbours {k % 7}" for k in range(30)]
    docs = [(k // 5, "\n".join(lines[k : k + 5])) for k in range(0, len(lines), 5)]
    expected = lines_by_hand(docs)
    links = line_dedup.line_links
    for block in (3, 512):
        monkeypatch.setattr(line_dedup, "line_links", lambda lines, edits, block=block: links(lines, edits, block))
        assert lines_found(spark, docs) == expected


def test_lines_are_native(spark, odd):
    for frame in (line_dedup.shared_keys(line_dedup.lines_of(odd)), *line_dedup.line_links(line_dedup.lines_of(odd)), line_dedup.near_lines(odd)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_repeated_short_lines_go(spark):
    docs = spark.createDataFrame([(1, "one\n\nsame"), (2, "same\n\ntwo\n \n\nsame"), (3, "same")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == {1: "one\n\nsame", 2: "\ntwo\n \n", 3: ""}


def test_drop_lines_odd(spark, odd):
    got = line_dedup.drop_repeated_lines(odd)
    assert got.columns == odd.columns and got.count() == len(ODD)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[2] is None and texts[1] == "" and texts[4] == ODD[4][1] and texts[5] == "" and texts[None] == ODD[2][1]
    assert all(r.n_chars == len(r.text or "") for r in got.where("text is not null").collect())
    assert line_dedup.near_lines(odd.limit(0)).count() == 0 and line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0


# -- 3 chat -------------------------------------------------------------------------------------

LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
    "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
    "dialogue": {"dialogue": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": ""}]},
    "prompt": {"prompt": "q", "completion": ""},
    "instruction": {"instruction": "q", "output": None},
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    turns = chat.canonical(LAYOUTS[layout], chat.registry())
    assert [(r, t) for _, r, t in turns] == [("user", "q"), ("assistant", "")]


def test_unknown_layouts(spark):
    rows = [(1, "{}"), (2, None), (3, "no json"), (4, '{"a": 1}'), (5, "[1]"), (6, '{"messages": []}'), (7, '{"messages": [{"role": "user"}]}'), (8, json.dumps({"instruction": "i", "input": "x", "output": "o"}))]
    turns = chat.to_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    got = turns.collect()
    assert {(r.conv_id, r.record) for r in chat.rejected(turns).collect()} == {r for r in rows if r[0] not in (6, 8)}
    assert {r.conv_id for r in chat.format_turns(turns).collect()} == {8}
    assert {r.conv_id for r in got if r.layout == "unknown"} == {1, 2, 3, 4, 5, 7}
    assert [(r.role, r.text) for r in got if r.conv_id == 8] == [("user", "i"), ("user", "x"), ("assistant", "o")]
    assert not [r for r in got if r.conv_id == 6]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("as#: \\<>/turn\n", max_size=12), st.text("#\\</turn>: \nabé", max_size=40)), max_size=5))
def test_template_round_trip(turns):
    made = [chat.render(r, t) for r, t in turns]
    assert list(chat.read_turns("".join(m[0] for m in made))) == turns
    assert [chat.unescape(m[0][m[1] : m[2]]) for m in made] == [t for _, t in turns]


def test_digests(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "yes 😀"), (1, 0, "user", "hi"), (2, 0, None, None), (3, 0, "assistant", tricky), (3, 0, "assistant", tricky), (3, 1, "user", "#" * 9), (4, 5, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    for size in (10, 1 << 20):
        formatted = chat.format_turns(chat.to_turns(chat.turn_records(table)), segment_chars=size)
        got = {r.conv_id: r for r in chat.digests(formatted).collect()}
        for conv in (1, 2, 3, 4):
            mine = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
            said = "".join(t for _, r, t in mine if r == "assistant")
            whole = "".join(f"{r}\n{t}\n" for _, r, t in mine)
            assert got[conv][1:5] == (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
            assert got[conv].formatted_chars == sum(len(r.formatted) for r in formatted.where(f"conv_id = {conv}").collect())
    assert chat.digests(chat.format_turns(chat.to_turns(chat.turn_records(table.limit(0))))).count() == 0


# -- 4 packing ----------------------------------------------------------------------------------

TEXTS = ["", " ", "a\x1cb c\x0bd\x0ce g\x85h", "İstanbul ΣΑΣ. don't it's 'll 12ab ab12. é́ ª µ ﬁ Ⅷ x².", "<|ENDOFTEXT|> <|endoftext|>a", "ÀÉß ÿ× ÷ø ÞÆ. İ. Aİ,", "汉字 日本語。 😀👍🏽 a..b ,. .", "a.,b.c, 1.5. x-1, '.", "A" * 3000 + "."]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aB.,' éÉ́İ1²\n\t<|>ſKß", max_size=40), min_size=1, max_size=5))
def test_word_ids(texts):
    words = packing.WordIds(VOCABULARY, most=50)
    for part in (texts, TEXTS):
        ids, begins = words.encode(pa.array([*part, None]))
        for k, e in enumerate(words.tokenizer.encode_batch([*part, ""], add_special_tokens=False)):
            assert ids[begins[k] : begins[k + 1]].tolist() == e.ids


@pytest.mark.parametrize("name", sorted(n.name for n in __import__("pathlib").Path(VOCABULARY).parent.glob("*.json")))
def test_any_tokenizer(name):
    try:
        words = packing.WordIds(str(__import__("pathlib").Path(VOCABULARY).parent / name))
    except Exception:  # noqa: BLE001
        pytest.skip("no file of the tokenizers library")
    ids, begins = words.encode(pa.array(TEXTS))
    for k, e in enumerate(words.tokenizer.encode_batch(TEXTS, add_special_tokens=False)):
        assert ids[begins[k] : begins[k + 1]].tolist() == e.ids


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, VOCABULARY)
    filled, sequences = rows.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert filled >= 0.97 * 2048 * sequences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_first_fit_decreasing(lengths):
    placed, used = packing.pack_group(lengths, 16)
    bins, by_hand = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = next((b for b, full in enumerate(bins) if full + lengths[k] <= 16), len(bins))
        bins += [0] * (at == len(bins))
        by_hand[k] = (at, bins[at])
        bins[at] += lengths[k]
    assert placed == [by_hand[k] for k in range(len(lengths))] and used == len(bins)


def test_pack_round_trip(spark, odd):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for group in (3, 10_000):
        rows = packing.pack(odd, VOCABULARY, 64, group=group).collect()
        for doc_id in {i for i, _ in ODD}:
            ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in ODD if i == doc_id]
            mine = [r for r in rows if r.doc_id == doc_id]
            assert sum(r.length for r in mine) == sum(map(len, ids))
            assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in mine) == sorted((s, len(x[s : s + 64]), zlib.crc32(struct.pack(f"<{len(x[s : s + 64])}I", *x[s : s + 64])), len(x)) for x in ids for s in range(0, len(x), 64))
        at = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at.get(r.sequence_id, 0)
            at[r.sequence_id] = r.offset + r.length
        assert max(at.values()) <= 64
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0


# -- 5 SimHash ----------------------------------------------------------------------------------


def simhash_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["", None, "One", "two WORDS", "É É\xa0b c d", "a b c d e f g " * 50, "x\x1cy z\x0bw v u", "Σ Ω İ ß"] + ["".join(random.Random(k).choices("ab cd", k=90)) for k in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(rows).collect()} == {k: simhash_by_hand(t) for k, t in enumerate(texts)}


def test_covering():
    r = np.random.default_rng(3)
    half = np.concatenate([r.integers(0, 1 << 32, 300, np.uint64), np.array([0, (1 << 32) - 1], np.uint64)])
    rows, near = simhash.anchors_within_two(half)
    assert (np.bitwise_count(half[rows] ^ near) <= 2).all() and not simhash._syndrome(near).any()
    held = [set(near[rows == k].tolist()) for k in range(len(half))]
    assert all(len(h) == (rows == k).sum() for k, h in enumerate(held))
    for k in range(len(half)):  # any neighbour at one bit shares an anchor, and none within two is missed
        for bit in range(32):
            a, b = simhash.anchors_within_two(half[k : k + 1] ^ np.uint64(1 << bit))
            assert held[k] & set(b.tolist())
    words = [w for w in range(0, 1 << 32, 65_537) if not simhash._syndrome(np.array([w], np.uint64)).any()]
    for w in words[:300]:
        for k in np.flatnonzero(np.bitwise_count(half ^ np.uint64(w)) <= 2):
            assert w in held[k]


@pytest.mark.parametrize("crowded", [2, 2048])
def test_fingerprint_links(spark, crowded):
    r = random.Random(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(25):
        centre = r.getrandbits(64)
        for _ in range(8):
            p = centre
            for _ in range(r.randint(0, 5)):
                p ^= 1 << r.randrange(64)
            prints.append(p)
    prints = sorted(set(prints))
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    at = {p - (1 << 64) if p >> 63 else p: k for k, p in enumerate(prints)}
    found = [(at[x.u], at[x.v]) for x in simhash.fingerprint_links(frame, crowded).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in found)
    assert components(len(prints), found) == components(len(prints), links)


def test_crowds_of_near_copies(spark):
    r = random.Random(6)
    centre = r.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in r.sample(range(64), 3)) for _ in range(400)})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    at = {signed(p): k for k, p in enumerate(prints)}
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    found = [(at[x.u], at[x.v]) for x in simhash.fingerprint_links(frame, 20).collect()]
    assert components(len(prints), found) == components(len(prints), links) and len(set(components(len(prints), links))) > 1


def test_parts():
    for mask in (0xFFFFFFFF, 0b1011, 1, 0):
        parts = simhash._parts(mask)
        assert sum(parts) == mask and len(parts) == 4


def test_near_duplicates_odd(spark, odd):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert got[1, zero] == got[2, zero] == got[6, zero] == 1
    assert {v for (d, _), v in got.items() if d in (4, 5)} == {4}
    assert got[None, f"{simhash_by_hand(ODD[2][1]):016x}"] is None
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "7", "None"]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.keep_one_each(odd.limit(0)).count() == 0


# -- 6 decontamination --------------------------------------------------------------------------


def held_by_hand(docs, items):
    found = set()
    for d, t in docs:
        grams = decontam.shingles(decontam.tokens(t or ""))
        for i, x in items:
            own = decontam.shingles(decontam.tokens(x))
            if own and len(own & grams) >= 0.8 * len(own):
                found.add((d, i))
    return found


def test_contaminated(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    items = [(k, " ".join(r.choices(words, k=r.randint(5, 60))) + ". " + " ".join(r.choices(words, k=6)) + ".") for k in range(40)] + [(90, "three only words"), (91, "")]
    docs = []
    for d in range(60):
        body = r.choices(words, k=r.randint(0, 400))
        if d % 2:
            text = items[r.randrange(40)][1].split()
            if d % 4 == 1:
                text[0] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() + r.choice(["", "!!", "***"]) for w in text]
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "Three, ONLY words"), (103, " | ".join(items[3][1].split()))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([*items, (None, "x"), (92, None)], "item_id long, text string")
    for shard in (2000, 1 << 24):
        rows = [(x.doc_id, x.item_id) for x in decontam.contaminated(frame, tests, shard).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == held_by_hand(docs, items)
    clean = decontam.keep_clean(frame, tests)
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in docs} - {d for d, _ in rows}


def test_short_items_within_documents(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(r.choices(words, k=1 + k % 6))) for k in range(24)] + [(90, "who wrote it? nobody")]
    docs = [(d, " ".join(r.choices(words, k=r.randint(0, 8)))) for d in range(60)]
    docs += [(100, "x " * 300 + "WHO, wrote it?! Nobody, " + "x " * 300), (101, "who wrote nobody it " + "x " * 20), (102, "who wrote it"), (103, None)]

    def holds(text, item):
        have, own = decontam.tokens(text or ""), decontam.tokens(item)
        n = min(5, len(own))
        grams = lambda x: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        return len(grams(own) & grams(have)) >= 0.8 * len(grams(own))

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for shard in (900, 1 << 24):
        got = sorted((x.doc_id, x.item_id) for x in decontam.contaminated(frame, tests, shard).collect())
        assert got == sorted((d, i) for d, t in docs for i, x in items if holds(t, x))
        assert (100, 90) in got


def test_no_item_is_below_the_threshold():
    r = random.Random(8)
    words = [f"w{k}" for k in range(80)]
    index = decontam.Index([(k, " ".join(r.choices(words, k=r.randint(5, 40))), "") for k in range(30)])
    for _ in range(400):
        at = r.randrange(30)
        coded = [w for w in decontam.tokens(index_text(index, at))]
        a = r.randint(0, len(coded) // 5)
        passage = [index.terms[w] for w in coded[a : len(coded) - r.randint(0, len(coded) // 5)]]
        if index.verified(passage, at):
            assert at in {x for x, _ in index.search(list(set(passage)))}


@pytest.mark.parametrize("block", [1, 3, 8])
def test_wand_gives_all_above_the_threshold(block):
    r = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    index = decontam.Index([(k, " ".join(r.choices(words, k=r.randint(1, 30))), "") for k in range(80)], block=block)
    for _ in range(300):
        query = list({index.terms[w] for w in r.choices(words, k=r.randint(0, 40)) if w in index.terms})
        scores = {}
        for t in query:
            places, impacts, *_ = index.lists[t]
            for at, x in zip(places, impacts, strict=False):
                scores[at] = scores.get(at, 0) + x
        for threshold in (0.3, 0.7, 1.0):
            got = index.search(query, threshold)
            assert [a for a, _ in got] == sorted(a for a, x in scores.items() if x >= threshold - 1e-9)
            assert all(abs(x - scores[a]) < 1e-9 for a, x in got)


def test_clean_rows_stay_beside_others_of_their_id(spark):
    items = spark.createDataFrame([(1, "who wrote the book about the harbour in the north? nobody knows it")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i in (None, 7) for t in ("who wrote the book about the harbour in the north? nobody knows it", "a clean text", None)], "doc_id long, text string")
    assert sorted(map(str, decontam.keep_clean(docs, items).collect())) == sorted(map(str, docs.where("text is null or text = 'a clean text'").collect()))


def index_text(index, at):
    names = {v: k for k, v in index.terms.items()}
    chain = sorted(index.shingles[at])
    return " ".join(names[t] for t in max(chain, key=len)) if len(chain) == 1 else " ".join(names[t] for s in chain for t in s)


def test_contaminated_odd(spark, odd):
    items = spark.createDataFrame([(1, "same text here for both of them, really")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(odd, items).collect()) == [4, 5, 5]
    kept = decontam.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert decontam.contaminated(odd, items.limit(0)).count() == 0 and decontam.contaminated(odd.limit(0), items).count() == 0


# -- 7 WARC -------------------------------------------------------------------------------------


def archive(spark, tmp_path, rows, name="a", **options):
    frame = spark.createDataFrame(rows, "page_id long, url string, payload binary").withColumn("digest", F.lit(1)).repartition(3)
    folder = f"file://{tmp_path}/{name}"
    manifest = warc.write(frame, folder, **options)
    return manifest, warc.read(spark, folder)


def test_archive(spark, tmp_path):
    big, other = b"x" * 1500, b"\xff" * 1000
    rows = [(5, "http://a/é\n", big), (9, "http://b", big), (2, None, big), (1, "u", b"s"), (3, "u", b"s"), (4, "u", None), (7, "u", other), (7, "u", other), (None, "u", b"n" * 2000), (8, "u", b"y" * 999)]
    manifest, read = archive(spark, tmp_path, rows, roll_bytes=200)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect())
    sha = lambda b: hashlib.sha1(b or b"").hexdigest()
    kinds = {5: ("revisit", 9), 2: ("revisit", 9)}
    expected = [(str(i), len(b or b""), sha(b), *kinds.get(i, ("response", None))) for i, _, b in rows]
    expected[7] = ("7", 1000, sha(other), "revisit", 7)
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    for r in manifest.collect():
        data = (tmp_path / "a" / r.file).read_bytes()
        assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    again, _ = archive(spark, tmp_path, rows, "b", roll_bytes=200)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(again.collect()) == sorted(manifest.collect())
    assert not list((tmp_path / "a").glob(".*.tmp"))


@pytest.mark.parametrize("most", [2, 10_000])
def test_each_payload_is_stored_once(spark, tmp_path, most):
    a, b = b"a" * 1200, b"b" * 1300
    rows = [(9, "u", a), (9, "u", b), (5, "u", b), (9, "v", b), (9, "w", a), (None, "u", a), (None, "u", a), (None, "u", b"c" * 2000), (-(2**62), "u", b"d"), (2**62, "u", b"d")]
    _, read = archive(spark, tmp_path, rows, shard_records=most)
    sha = {hashlib.sha1(x).hexdigest(): x[:1].decode() for _, _, x in rows}
    got = sorted((str(r.page_id), sha[r.payload_digest], r.record_type, r.refers_to) for r in read.collect())
    assert [g[:2] for g in got] == sorted((str(i), x[:1].decode()) for i, _, x in rows)
    assert sorted(g[1] for g in got if g[2] == "response") == ["a", "b", "c", "d", "d"]
    assert all(g[3] == (9 if g[2] == "revisit" else None) for g in got)
    heads = [warc.parse_record(data)[0] for f in (tmp_path / "a").glob("*.gz") for data in warc.members(f.open("rb"))]
    responses = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in heads if h["WARC-Type"] == "response"}
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    assert all(responses[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in heads if h["WARC-Type"] == "revisit")


def test_damaged_archive(spark, tmp_path):
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(warc.make_record(1, 0, "u", b"payload", None).replace(b"payload", b"paYload"))
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(__import__("io").BytesIO(warc.compressed(b"data" * 100)[:-9])))
    head = warc.parse_record(warc.make_record(3, 0, "u", b"p", 9))[0]
    assert head["WARC-Refers-To"] == warc.record_id(9, hashlib.sha1(b"p").hexdigest()) and base64.b32decode(head["WARC-Payload-Digest"][5:]) == hashlib.sha1(b"p").digest()


def test_empty_archive(spark, tmp_path):
    manifest, read = archive(spark, tmp_path, [])
    assert manifest.count() == 0 and read.count() == 0


# -- 8 embeddings -------------------------------------------------------------------------------


@pytest.mark.parametrize(("kind", "crowded"), [("float", 20_000), ("double", 20_000), ("double", 60)])
def test_embedding_near_duplicates(spark, kind, crowded):
    r = np.random.default_rng(6)
    base = r.standard_normal((150, 16))
    near = np.concatenate([base[k % 20] + r.standard_normal((1, 16)) * r.uniform(0.02, 0.4) for k in range(200)]).reshape(-1, 16)
    rows = np.concatenate([base, near, base[:5], base[:5], 3 * base[:2]]).astype(np.float32 if kind == "float" else np.float64)
    ids = r.permutation(len(rows)).tolist()
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [1.0, None] + [0.0] * 14), (1003, [float("nan")] * 16), (1004, []), (None, rows[0].tolist()), (1005, [float("inf")] + [0.0] * 15)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, rows, strict=True)] + odd, f"vec_id long, embedding array<{kind}>").withColumn("key", F.lit(1)).withColumn("vec", F.lit(2))
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    part = components(len(rows), list(zip(*np.nonzero(np.triu(close)), strict=True)))
    low = {p: min(ids[k] for k in range(len(rows)) if part[k] == p) for p in part}
    got = {x.vec_id: x for x in embedding.near_duplicates(table, leaf=40, crowded=crowded).collect()}
    assert len(got) == len(rows) + len(odd)
    n = np.array([got[i].n_links for i in ids])
    assert (n <= close.sum(1)).all() and n.sum() >= 0.98 * close.sum()
    assert np.mean([got[i].component_id == low[part[k]] for k, i in enumerate(ids)]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    for i, _ in odd:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept == (i is not None)
    assert embedding.near_duplicates(table.limit(0)).count() == 0


def test_crowded_leaves_are_compared_whole(spark):
    r = np.random.default_rng(7)
    centre = r.standard_normal(64)
    rows = centre / np.linalg.norm(centre) + r.standard_normal((700, 64)) * np.sqrt(0.05 / 64)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    part = components(len(rows), list(zip(*np.nonzero(np.triu(close)), strict=True)))
    for crowded in (100, 20_000):  # one outer leaf, split or not
        got = {x.vec_id: (x.n_links, x.component_id) for x in embedding.near_duplicates(table, leaf=1000, crowded=crowded).collect()}
        assert got == {k: (close[k].sum(), part[k]) for k in range(len(rows))}
    whole, cut = (sorted(map(tuple, embedding.near_duplicates(table, leaf=100, crowded=c).collect())) for c in (20_000, 60))
    assert whole == cut


@pytest.mark.parametrize("sample", [embedding.SAMPLE_BYTES, 64 * 8 * 200])  # the smaller tells 3 levels apart, so most of the trees are beyond it
def test_recall_on_the_table(spark, sample):
    d = "/root/testdata/sf0.1/embeddings.parquet"
    table = spark.read.parquet(d)
    rows = table.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = (x @ x.T >= 0.95).sum() - len(x)
    found = embedding.near_duplicates(table, leaf=4 if sample < 1 << 20 else 250, sample_bytes=sample).agg(F.sum("n_links")).first()[0]
    assert exact >= found >= 0.9 * exact


# -- 9 PII --------------------------------------------------------------------------------------


def luhn_ok(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark):
    rows = [
        (1, "card 4845168114407329 and 4845 1681 1440 7329, bad 4845168114407328."), (2, "+1 (017) 555-7713 mail und.34@mail7.example.com%%% ip 97.51.17.173!! 999.1.1.1 v1.2.3.4"),
        (3, "DE89 3704 0044 0532 0130 00 DE89370400440532013000 DE88370400440532013000"), (4, "ssn 123-45-6789 000-45-6789 on 2024-02-29 2023-02-29 31.12.1999 12/31/1999 31/12/1999 31/02/1999"),
        (5, "+1 (017) 555-7713, 4845168114407329"), (6, None), (7, ""), (8, "no data, Version 2.0. 04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    a, b, bad = re.match(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), bad (\d{16})\.", got[1].text).groups()
    assert a == b.replace(" ", "") != "4845168114407329" and a[0] == "4" and luhn_ok(a) and bad == "4845168114407328" and got[1].n_card == 2
    phone, name, ip = re.match(r"(\+1 \(\d{3}\) \d{3}-\d{4}) mail (\w+)@mail7.example.com%%% ip (\S+)!! 999.1.1.1 v1.2.3.4", got[2].text).groups()
    assert got[5].text == f"{phone}, {a}" and name != "und.34" and all(0 <= int(x) < 256 for x in ip.split(".")) and (got[2].n_phone, got[2].n_email, got[2].n_ip) == (1, 1, 1)
    x, y, z = re.match(r"(DE[\d ]{25}) (DE\d{20}) (DE\d{20})", got[3].text).groups()
    assert x.replace(" ", "") == y != z == "DE88370400440532013000" and int(y[4:] + "1314" + y[2:4]) % 97 == 1 and got[3].n_iban == 2
    ssn, bad, iso, no, dot, am, dd, no2 = got[4].text.removeprefix("ssn ").replace("on ", "").split()
    assert (bad, no, no2) == ("000-45-6789", "2023-02-29", "31/02/1999") and ssn != "123-45-6789" and got[4].n_date == 4
    assert dot.split(".") == [am.split("/")[1], am.split("/")[0], am.split("/")[2]] and int(dd.split("/")[0]) > 12
    assert got[6].text is None and got[7].text == "" and got[8].text == rows[7][1] and got[8].n_card == 0


def test_further_formats(spark):
    rows = [
        (1, "GB82 WEST 1234 5698 7654 32 GB82WEST12345698765432 FR1420041010050500013M02606 GB83 WEST 1234 5698 7654 32"),
        (2, "3/5/1990, 1990/03/05, March 5, 1990, 5 March 1990, 5.3.1990, 1990-03-05, 31 February 1990"), (3, "1-974-555-3436 974-555-3436 +1 (974) 555-3436"), (4, "3782 822463 10005 and 378282246310005"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    a, b, c, d = re.match(r"(GB\d\d WEST \d{4} \d{4} \d{4} \d\d) (GB\d\dWEST\d{14}) (FR\d{19}M\d{5}) (GB83 WEST 1234 5698 7654 32)$", got[1].text).groups()
    assert a.replace(" ", "") == b != "GB82WEST12345698765432" and all(int("".join(str(int(x, 36)) for x in i[4:] + i[:4])) % 97 == 1 for i in (b, c))
    import datetime

    words = got[2].text.split(", ")
    day = datetime.date.fromisoformat(words[-2])
    assert words == [f"{day.month}/{day.day}/{day.year}", day.strftime("%Y/%m/%d"), f"{day:%B} {day.day}", str(day.year), f"{day.day} {day:%B} {day.year}", f"{day.day}.{day.month}.{day.year}", day.isoformat(), "31 February 1990"]
    one, two, three = re.match(r"(1-\d{3}-\d{3}-\d{4}) (\d{3}-\d{3}-\d{4}) (\+1 \(\d{3}\) \d{3}-\d{4})$", got[3].text).groups()
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(one) == digits(three) == "1" + digits(two) and two != "974-555-3436"
    one, two = re.match(r"(\d{4} \d{6} \d{5}) and (\d{15})$", got[4].text).groups()
    assert digits(one) == two and luhn_ok(two)


def test_cards_beside_other_numbers(spark):
    card, grouped = "4845168114407329", "4845 1681 1440 7329"
    rows = [f"{card}", f"{card} 12/27", f"{card} 123", f"12 {card}", f"no 1 {card} 22 ok", f"123 {grouped}", f"{grouped} 12/27", f"{grouped} 1 2 3 4", f"1 2 3 5 {card} {card}", f"{card}-12", "4845168114407328 12"]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    new = got[0]
    assert new != card and luhn_ok(new)
    spaced = " ".join(new[k : k + 4] for k in range(0, 16, 4))
    assert got == [x.replace(card, new).replace(grouped, spaced) for x in rows]


def digits_by_hand(key, kind, digits):
    """The Feistel network in whole numbers: rounds 2, 4, ... add to the upper half, the others to the lower."""
    n, low = len(digits), len(digits) // 2
    a, b = int(digits[: n - low]), int(digits[n - low :])
    mix = lambda r, half: int(hashlib.sha256(f"{key}|{kind}|{n}|{r}|{half}".encode()).hexdigest()[:15], 16)
    for r in range(1, pii.ROUNDS + 1):
        if r % 2 == 0:
            a = (a + mix(r, b)) % 10 ** (n - low)
        else:
            b = (b + mix(r, a)) % 10**low
    return f"{a:0{n - low}}{b:0{low}}"


def test_cards_in_long_runs(spark):
    cards = ["4845 1681 1440 7329", "4845168114407329", "3782-822463-10005"]
    rows = [f"1234 {cards[0]}", f"1 2 3 4 5 6 7 8 9 {cards[1]} 1 2 3 4 5", f"{cards[0]} {cards[1]} {cards[2]}", f"{cards[1]} 12th", f"{cards[1]} 7-8x", " ".join(["7"] * 40_000) + f" {cards[1]}"]
    rows += [f"{cards[1]} 123-45-6789", f"{cards[1]} 2024-01-02", f"{cards[1]} 97.51.17.173", f"{cards[1]} 5 March 1990", f"{cards[1]} 12@mail.example.com", f"{cards[1]} 800-555-1234"]
    got = pii.pseudonymised(spark.createDataFrame(list(enumerate([*cards, *rows])), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = dict(zip(cards, (r.text for r in got), strict=False))
    for row, was in zip(got[3:9], rows, strict=False):
        for c in cards:
            was = was.replace(c, new[c])
        assert row.text == was
    assert [r.n_card for r in got[3:]] == [1, 1, 3, 1, 1, 1] + [1] * 6
    for row, kind in zip(got[9:], ["ssn", "date", "ip", "date", "email", "phone"], strict=True):
        assert row.text.startswith(new[cards[1]] + " ") and row[f"n_{kind}"] == 1
        assert row.text.split(" ", 1)[1] != rows[got.index(row) - 3].split(" ", 1)[1]


def cards_by_hand(run, key):
    """Cards of whole groups, from the left; of those that overlap the last taken one, one of more digits takes its place."""
    ends = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]
    spans = [(a, b, re.sub("[^0-9]", "", run[a:b])) for i, (a, _) in enumerate(ends) for _, b in ends[i:]]
    taken = []
    for span in (x for x in spans if 13 <= len(x[2]) <= 19 and luhn_ok(x[2]) and set(x[2]) != {"0"}):
        if not taken or span[0] >= taken[-1][1]:
            taken.append(span)
        elif len(span[2]) > len(taken[-1][2]):
            taken[-1] = span
    for a, b, c in reversed(taken):
        body = c[0] + digits_by_hand(key, "card", c[1:-1])
        new = iter(next(body + d for d in "0123456789" if luhn_ok(body + d)))
        run = run[:a] + "".join(next(new) if x.isdigit() else x for x in run[a:b]) + run[b:]
    return run, len(taken)


def test_runs_by_hand(spark):
    r = random.Random(9)
    key, runs = pii.derived("k", "card"), ["0000 0000 0000 0000 0000", "7" * 30 + " 4845168114407329"]
    for _ in range(150):  # groups of these lengths begin no value of another kind
        runs.append(" ".join("".join(r.choices("0123456789", k=r.choice((1, 2, 4, 5, 6, 16)))) for _ in range(r.randint(3, 25))))
    got = pii.pseudonymised(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [(x.text, x.n_card) for x in got] == [cards_by_hand(x, key) for x in runs]


def test_pseudonyms_by_hand(spark):
    r = random.Random(4)
    key = {k: pii.derived("secret", k) for k in pii.KINDS}
    cards, ssns, ibans = [], [], []
    while len(cards) < 20:
        c = "4" + "".join(r.choices("0123456789", k=15))
        cards += [c] * luhn_ok(c)
    while len(ssns) < 20:
        x = "".join(r.choices("0123456789", k=9))
        ssns += [x] * (x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000")
    for _ in range(20):
        bare = "".join(r.choices("0123456789", k=18))
        ibans.append(f"DE{98 - int(bare + '131400') % 97:02}{bare}")
    expected = []
    for c, x, i in zip(cards, ssns, ibans, strict=True):
        body = c[0] + digits_by_hand(key["card"], "card", c[1:-1])
        card = next(body + d for d in "0123456789" if luhn_ok(body + d))
        while True:
            x = digits_by_hand(key["ssn"], "ssn", x)
            if x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000":
                break
        bare = digits_by_hand(key["iban"], "iban", i[4:])
        expected.append(f"{card}, {x[:3]}-{x[3:5]}-{x[5:]}, DE{98 - int(bare + '131400') % 97:02}{bare}")
    rows = [(k, f"{c}, {x[:3]}-{x[3:5]}-{x[5:]}, {i}") for k, (c, x, i) in enumerate(zip(cards, ssns, ibans, strict=True))]
    frame = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "secret")
    assert [x.text for x in frame.orderBy("doc_id").collect()] == expected
    assert "'secret" not in frame._jdf.queryExecution().toString() and "secret|" not in frame._jdf.queryExecution().toString()


def test_long_names_of_addresses(spark):
    row = spark.createDataFrame([(1, f"{'a' * 200}@mail.example.com")], "doc_id long, text string")
    assert pii.pseudonymised(row, "k").first().n_email == 1


def test_permutations_are_one_to_one(spark):
    rows = spark.range(1000)
    two = rows.where("id < 100").select(F.expr(pii.digits_permuted("k", "card", "lpad(cast(id as string), 2, '0')")).alias("d"))
    assert {r.d for r in two.collect()} == {f"{k:02d}" for k in range(100)}
    three = rows.select(F.expr(pii.digits_permuted("k", "card", "lpad(cast(id as string), 3, '0')")).alias("d"))
    assert {r.d for r in three.collect()} == {f"{k:03d}" for k in range(1000)}
    days = spark.range(73_049).select(F.expr(pii.walked(pii.feistel("k", "date", "y", "271", "270"), "id", "y < 73049")).alias("y"))
    assert days.where("y between 0 and 73048").distinct().count() == 73_049


def test_pii_is_native_and_whole(spark, odd):
    frame = pii.pseudonymised(odd, "k")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert sorted(map(str, frame.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert set(odd.columns) <= set(frame.columns) and len(frame.columns) == len(set(frame.columns))
    assert pii.pseudonymised(odd.limit(0), "k").count() == 0


# -- 10 language --------------------------------------------------------------------------------


def test_spectrum_does_not_depend_on_blocks(monkeypatch):
    text = "Ünder the Brücke, été 12 汉字 😀 " * 30
    whole = language.Spectrum()(text)
    monkeypatch.setattr(language, "BLOCK", 50)
    assert (language.Spectrum()(text) == whole).all() and len(whole) == len(set(whole.tolist()))


def grams_by_hand(text):
    letters = [c.lower()[:1] if c.lower()[:1].isalpha() else " " for c in f" {text} "]
    return {tuple(letters[k : k + n]) for n in (1, 2, 3) for k in range(len(letters) - n + 1)}


@pytest.mark.parametrize("texts", [["Мама мыла раму", "мама"], ["ΑΒΓ αβγδ", "αβ"], ["سلام دنیا", "سلام"], ["汉字 日本語", "日本"], ["The cat", "the CAT sat"]])
def test_spectrum_by_hand(texts):
    s = language.Spectrum()
    a, b = (set(s(t).tolist()) for t in texts)
    x, y = map(grams_by_hand, texts)
    assert (len(a), len(b), len(a & b)) == (len(x), len(y), len(x & y))


def test_kernel_ridge_by_hand():
    """The score of each text from the regression's own equations, all rows landmarks: weights = K~ (K + ridge)^-1 y, languages weighed alike."""
    s = language.Spectrum()
    texts = ["the cat sat", "the dog ran", "a big house", "le chat noir", "le chien dort", "der hund bellt"]
    langs = ["en", "en", "en", "fr", "fr", "de"]
    rows = [s(t) for t in texts]
    model = language.fit(rows, langs, landmarks=6, ridge=0.1)
    grams = [grams_by_hand(t) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    y = np.where(np.array(langs)[:, None] == np.array(["de", "en", "fr"]), 1.0, -1.0)
    weigh = np.diag([6 / (3 * langs.count(x)) for x in langs])
    # in the kernel's own space: minimise sum weigh (f - y)^2 + ridge |f|^2, so f = K a with a = (weigh K + ridge)^-1 weigh y
    scores = kernel @ np.linalg.solve(weigh @ kernel + 0.1 * np.eye(6), weigh @ y)
    assert np.allclose(model.kernel(rows) @ model.weights, scores, atol=2e-3)
    share = np.exp(6 * scores) / np.exp(6 * scores).sum(1, keepdims=True)
    best, got = model.predict(rows)
    assert best.tolist() == scores.argmax(1).tolist() and np.allclose(got, share.max(1), atol=5e-3)


def test_kernel_by_hand():
    s = language.Spectrum()
    texts = ["the cat", "the dog", "le chat noir", "le chien"]
    rows = [s(t) for t in texts]
    model = language.fit(rows, ["en", "en", "fr", "fr"], landmarks=4, ridge=1e-3)
    k = model.kernel(rows)
    order = [0, 2, 1, 3]  # landmarks are taken in turn from each language
    for a in range(4):
        for j, b in enumerate(order):
            both = len(set(rows[a].tolist()) & set(rows[b].tolist()))
            assert abs(k[a, j] - both / np.sqrt(len(rows[a]) * len(rows[b]))) < 1e-5
    assert [model.langs[x] for x in model.predict(rows)[0]] == ["en", "en", "fr", "fr"]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_language_odd(spark, odd):
    rows = language.identify(odd, language.train_model(odd)).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 6)) and 0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in language.identify(odd, language.train_model(odd.limit(0))).collect())
    assert language.identify(odd.limit(0), None).count() == 0
