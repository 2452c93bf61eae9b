"""Rows that used to end a job, lose rows or change with their order."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import chat, embedding, language, line_dedup, packing, pii, queries, warc


def test_records_that_cannot_be_turns(spark):
    deep = "[" * 100_000 + "]" * 100_000
    bad = [
        '{"turn": 0, "role": "user", "text": "\\ud800"}', '{"turn": 0, "role": "\\udfff", "text": "x"}', '{"turn": "first", "role": "user", "text": "x"}', '{"turn": 99999999999999999999, "role": "user", "text": "x"}',
        '{"turn": 1.5, "role": "user", "text": "x"}', '{"turn": true, "role": "user", "text": "x"}', deep, '{"turn": 0, "role": "user", "text": %s}' % deep, '{"messages": [{"role": "user", "content": "\\ud800"}]}', "null", "", None,
    ]
    good = ['{"turn": null, "role": "user", "text": "\\ud83d\\ude00"}', '{"turn": -9223372036854775807, "role": null, "text": null}', '{"prompt": "p", "completion": 1.5}']
    records = spark.createDataFrame([(k, r) for k, r in enumerate(bad + good)], "conv_id long, record string")
    turns = chat.to_turns(records)
    assert sorted((r.conv_id, r.record) for r in chat.rejected(turns).collect()) == list(enumerate(bad))
    read = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert {k: r.n_turns for k, r in read.items()} == {len(bad): 1, len(bad) + 1: 1, len(bad) + 2: 2}
    assert {(r.turn, r.role, r.text) for r in turns.where("layout <> 'unknown'").collect()} == {(0, "user", "😀"), (-9223372036854775807, "", ""), (0, "user", "p"), (1, "assistant", "1.5")}


def test_one_response_a_payload_without_ids(spark, tmp_path):
    same, other = b"x" * 1500, b"y" * 1500
    rows = [(None, "a", same), (None, "b", same), (None, "c", same), (None, "d", other), (7, "e", other), (None, "f", b"z" * 1500), (None, "g", b"small"), (None, "h", b"small"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    warc.write(pages, f"file://{tmp_path}")
    got = warc.read(spark, f"file://{tmp_path}").collect()
    kinds = sorted((r.url, r.record_type, r.refers_to) for r in got)
    assert [(t, to) for u, t, to in kinds if u in "abc"] == [("response", None), ("revisit", None), ("revisit", None)]
    assert [(t, to) for u, t, to in kinds if u in "defgh"] == [("revisit", 7), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert len(got) == len(rows)
    head = warc.parse_record(warc.make_record(None, 1, "u", same, None, True))[0]
    first = warc.parse_record(warc.make_record(None, 0, "u", same, None, False))[0]
    assert head["WARC-Refers-To"] == first["WARC-Record-ID"] != head["WARC-Record-ID"]


def test_one_line_of_a_class_is_kept(spark):
    line, near = "a line that is long enough to have links", "a line that is long enough to have linkz"
    docs = [(None, line), (None, line + "\nalone"), (7, line), (7, "x\n" + line), (7, near), (8, near + "\n" + line), (None, None)]
    rows = line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    of_class = [r for r in rows if r.n_links]
    assert len(of_class) == 7 and sum(r.kept for r in of_class) == 1
    first = next(r for r in of_class if r.kept)
    assert first.doc_id is None and {(r.class_doc_id, r.class_line_no) for r in of_class} == {(None, 0)}
    assert {(r.n_copies, r.n_links) for r in of_class} == {(5, 1), (2, 1)}
    assert sum(r.kept for r in rows if not r.n_links) == 2  # "alone" and "x"


def test_pieces_are_dealt_by_what_they_are(spark, small):
    import public_tokenizers

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    path = public_tokenizers.path("word_bpe_49k.json")
    orders = [docs, docs.orderBy(F.desc("doc_id")).coalesce(1), docs.repartition(3, F.xxhash64("text"))]
    packed = [sorted(map(tuple, packing.pack(d, path).collect())) for d in orders]
    assert packed[0] == packed[1] == packed[2]


@pytest.mark.parametrize("dims", [64, 256, 768])
def test_a_forest_spills_alike_at_any_dimension(dims):
    rng = np.random.default_rng(dims)
    unit = rng.normal(size=(6000, dims))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = rng.normal(size=unit.shape)
    turned -= (turned * unit).sum(1, keepdims=True) * unit
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    near = 0.96 * unit + (1 - 0.96**2) ** 0.5 * turned
    depth, trees = 5, 6
    forest = embedding.plant(unit, depth, trees, embedding.SPILL / dims**0.5)
    met, copies = np.zeros(len(unit), bool), 0
    for t in range(trees):
        p, q = forest.projections(unit, t), forest.projections(near, t)
        rows, _ = forest.leaves(p, p, t)
        copies += len(rows)
        both, _ = forest.leaves(np.minimum(p, q), np.maximum(p, q), t)
        met[both] = True
    assert (copies / len(unit) / trees) ** (1 / depth) <= 1.15
    assert met.mean() >= 0.9


def test_whole_numbers_keep_their_digits(spark):
    big = 2**40
    rows = [(1, [big, 1, 0]), (2, [big, 1, 0]), (3, [1, big, 0])]
    for kind in ("long", "decimal(20,0)", "double"):
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<long>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(vectors).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    exact = spark.createDataFrame([(1, [2**30 + 1, 0]), (2, [2**30, 0])], "vec_id long, embedding array<int>")
    packed = [r.vec for r in embedding._packed(exact, "<f8").collect()]
    assert packed[0] != packed[1]


def test_an_item_without_its_answer_is_no_leak(spark, tmp_path):
    body = " ".join(f"word{k}" for k in range(60))
    items = [(1, f"{body}. It is quite forty two."), (2, "one single sentence of seven words here"), (3, "Who? Me.")]
    docs = [(1, f"before {body}. It is quite forty two. after"), (2, f"before {body} after"), (3, f"{body}. It is quite forty three"), (4, f"{body}. It is quite other"), (5, "so one single sentence of seven words here it is"), (6, None), (7, "nothing at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op6_decontamination(spark, str(tmp_path)).collect()))
    assert [r[:2] for r in got] == [(1, 1), (3, 1), (5, 2)]
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(queries.LEAKS_SQL).fetchall()) == got


def test_letters_of_any_plane():
    spectrum = language.Spectrum()
    bold, hangul = "\U0001d400\U0001d401", "\ud400\ud401"  # the same in their lower 16 bits
    assert set(spectrum(bold)) != set(spectrum(hangul)) and len(spectrum(bold)) == len(spectrum(hangul))
    assert set(spectrum("a\U00010428b")) == set(spectrum("A\U00010400B"))  # Deseret, in either case
    assert set(spectrum("x\U0001f600y")) == set(spectrum("x!y"))  # no letter


def test_spectra_at_the_driver_are_bounded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole, few = language.train_model(docs), language.train_model(docs, most_bytes=60_000)
    assert few.landmarks.shape[1] < whole.landmarks.shape[1] and language.train_model(docs, most_bytes=10) is None


def test_no_key_is_shown(spark):
    rows = spark.createDataFrame([(1, "4845168114407329, 123-45-6789, a@b.example", "x", "y")], "doc_id long, text string, keys string, found string")
    frame = pii.pseudonymised(rows, "secret")
    got = frame.first()
    assert (got.keys, got.found, got.n_card, got.n_ssn, got.n_email) == ("x", "y", 1, 1, 1)
    shown = frame._jdf.queryExecution().toString()
    assert "secret" not in shown and not [k for k in pii.KINDS if pii.derived("secret", k) in shown]
