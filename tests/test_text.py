"""Cleaning and chunking against worked examples and a model written apart from the engine."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.operators import chunking, cleaning


def model_clean(text):
    lines = [x.strip() for x in text.split("\n")]
    often = {x for x, n in Counter(x for x in lines if len(x) > 10).items() if n >= 3}
    noisy = [re.compile(p, re.IGNORECASE) for _, _, p in cleaning.NOISE]
    out = " ".join(x for x in lines if x and x not in often and not any(p.search(x) for p in noisy))
    for a, b in cleaning.OCR_LITERALS:
        out = out.replace(a, b)
    out = re.sub(r"\b0\b(?=\s*[a-zA-Z])", "O", out)
    out = re.sub(r"\bl\b(?=\s*\d)", "1", out)
    return re.sub(r"\s+", " ", out).strip()


def model_chunks(parts, size, overlap):
    """Every chunk from its own start: as many sentences as fit, or one that does not."""
    out, begin, at = [], "", 0
    while at < len(parts):
        here, first = begin, at
        while at < len(parts) and len(here) + len(parts[at]) + 1 <= size:
            here, at = here + parts[at] + " ", at + 1
        if at == first:
            here, at = parts[at], at + 1
        out.append(here.strip())
        begin = here[max(0, len(here) - overlap) :] if overlap else ""
    return out


CASES = [
    ("Take this medicine daily.", ""), ("Waiting period is thirty days\nNext line.", "Next line."),
    ("Total medical NO claim, 0 days ( a ) x / y . z", "Tota1 medica1 N0 claim, O days (a) x/y. z"), ("abc\nabc\nabc", "abc abc abc"),
    ("repeat line here\nkeep.\nrepeat line here\nrepeat line here", "keep."), ("", ""), (None, ""), ("   \n\t\n", ""), ("a b c.", "a b c."),
    ("see www.example.com now.", ""), ("E-mail: a@b.c is here.", ""), ("Page 3 of 10.", ""), ("42", ""), ("4 2.", "4 2."), ("Reg No 123.", ""), ("l\t5.", "1 5."),
]


def test_clean_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.cleaned for r in cleaning.clean(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [e for _, e in CASES]


def test_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = cleaning.clean(docs).collect()
    assert len(rows) == docs.count() and all(r.cleaned == model_clean(r.text) for r in rows)
    assert not any("  " in r.cleaned for r in rows)


def test_strict_noise_keeps_words(spark):
    rows = spark.createDataFrame([(1, "Take this medicine, genuine.")], "doc_id long, text string")
    assert cleaning.clean(rows, strict_noise=True, ocr_fixes=False).first().cleaned == "Take this medicine, genuine."


def test_no_shuffle_in_cleaning(spark, small):
    plan = cleaning.clean(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab .", min_size=1, max_size=30).map(str.strip).filter(bool), max_size=12), st.integers(5, 40), st.integers(0, 12))
def test_pack_model(parts, size, overlap):
    assert chunking.pack_sentences(parts, size, overlap) == model_chunks(parts, size, overlap)


@pytest.mark.parametrize(
    ("size", "overlap", "text", "expected"),
    [
        (20, 5, "Aaaa bbbb. Cccc dddd. Eeee ffff gggg hhhh iiii. Jj.", ["Aaaa bbbb.", "bbb. Cccc dddd.", "Eeee ffff gggg hhhh iiii.", "iiii.Jj."]),
        (30, 10, "Aaaa bbbb. Cccc dddd. Eeee ffff gggg.", ["Aaaa bbbb. Cccc dddd.", "ccc dddd. Eeee ffff gggg."]),
        (12, 5, "no terminator at all here", ["no terminator at all here"]),
        (12, 0, "One two. Three four.", ["One two.", "Three four."]),
        (12, 5, "", []),
    ],
)
def test_chunk_cases(spark, size, overlap, text, expected):
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = chunking.sentences(F.col("text"))
    assert row.select(chunking.packed(parts, size, overlap)).first()[0] == expected
    assert row.select(chunking.packed_native(parts, size, overlap)).first()[0] == expected


def test_chunk_bound(spark, small):
    docs = cleaning.clean(spark.read.parquet(f"{small}/documents.parquet"))
    sentences = {(r.doc_id, s) for r in docs.select("doc_id", chunking.sentences(F.col("cleaned")).alias("s")).collect() for s in r.s}
    for r in chunking.chunks(docs).collect():
        assert len(r.text) <= 512 or (r.doc_id, r.text) in sentences


def test_noise_near_misses(spark):
    lines = ["NIU 12", "Reg of No", "CNI 5", "Page three of four.", "4x", "www.example.org!", "E-mail to me!", "Call me: Toll Free!", "For details, Toll.", "Head Office: here!", "Plot no 5!", "Short!"]
    rows = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert cleaning.kept_lines(rows).first().lines == lines


def test_chunks_of_rows(spark):
    import random

    from veldspar.sources import files

    rng, docs = random.Random(11), []
    for d in range(40):
        sizes = rng.choice([[3, 20, 60], [40, 380, 415, 440, 461, 462, 463], [1, 30, 511, 512, 600], [2]])
        docs.append((d, [("x" * (rng.choice(sizes) - 1)) + "." for _ in range(rng.choice([1, 2, 5, 40, 300]))]))
    docs += [(None, ["first.", "second."]), (100, ["a." * 3000, "b."]), (101, ["s.", "t" * 509 + ".", "u."]), (102, ["s.", "t" * 470 + ".", "u."])]
    rows = spark.createDataFrame([(d, i, p) for d, parts in docs for i, p in enumerate(parts)], "doc_id long, i int, part string")
    for size, overlap in ((512, 50), (120, 0)):
        expected = sorted((str(d), k, t) for d, parts in docs for k, t in enumerate(chunking.pack_sentences(parts, size, overlap)))
        assert sorted((str(r.doc_id), r.chunk_index, r.text) for r in chunking.chunks_of_rows(rows, files.written, size, overlap).collect()) == expected
    assert chunking.chunks_of_rows(rows.limit(0), files.written).collect() == []
    cut = chunking.placed(rows, block=7)
    assert sorted(map(str, cut.collect())) == sorted(map(str, chunking.placed(rows).collect()))
    short = chunking.followers(cut, 512, 50, stretch=700)  # stretches of a few parts
    assert sorted(map(str, short.collect())) == sorted(map(str, chunking.followers(cut, 512, 50).collect()))
