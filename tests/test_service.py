"""Parsers, store, retrieval, answers and the service on small inputs."""

import email.message
import io
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veldspar.config import PipelineConfig
from veldspar.functions import html, pdf
from veldspar.operators import answering, embedding, parsers, retrieval, store
from veldspar.plans import service
from veldspar.sources import files
from veldspar.streaming import ingest as streaming
from veldspar.streaming import landing

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def para(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def cell(t, span=0):
    return f"<w:tc>{f'<w:tcPr><w:gridSpan w:val={chr(34)}{span}{chr(34)}/></w:tcPr>' if span else ''}{para(t)}</w:tc>"


BASIC = docx(para("First.") + para("  ") + para("Second.") + f"<w:tbl><w:tr>{cell('k', 2)}{cell('v')}</w:tr><w:tr>{cell('1')}{cell('2')}{cell('3')}</w:tr><w:tr>{cell('x')}</w:tr></w:tbl>")


def mail():
    m = email.message.EmailMessage()
    m["Subject"] = "s"
    m.set_content("Plain text.\n")
    m.add_alternative("<p>Html <b>text</b></p><table><tr><th>h</th><th>g</th></tr><tr><td>1</td><td>none</td></tr></table>", subtype="html")
    m.add_attachment(b"\x00", maintype="application", subtype="octet-stream")
    return m.as_bytes()


def test_html_nested_tables():
    text, grids = html.parsed("<script>no</script>a<table><tr><td>1<table><tr><td>in</td></tr><tr><td>ner</td></tr></table></td></tr><tr><td>2</td></tr></table><!-- c -->b&amp;<table><tr><td>x</td></tr></table>")
    assert text == "a1inner2b&x"
    assert [["in"], ["ner"]] in grids and len(grids) == 2


def test_html_udtf(spark):
    rows = spark.createDataFrame([("<table><tr><td> a </td></tr><tr><td>b</td></tr></table>",)], "html string")
    spark.udtf.register("html_tables", html.HtmlTables)
    rows.createOrReplaceTempView("html_pages")
    assert [tuple(r) for r in spark.sql("select t.* from html_pages, lateral html_tables(html) t order by row_idx").collect()] == [(0, 0, ["a"]), (0, 1, ["b"])]


def test_parse_files(spark, tmp_path):
    for name, data in {"a.docx": BASIC, "b.eml": mail(), "c.msg": b"\xff\xfe", "d.doc": b"junk", "e.pdf": b"%PDF", "f.txt": b"x", "g.docx": docx("<w:tbl/>")}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.source_file[-6:]: r for r in service.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "First. Second.; k: 1, k: 2, v: 3"
    assert got["/b.eml"].text == "Plain text. Htm1 texthg1none; h: 1"
    assert {k: r.status for k, r in got.items()} == {"a.docx": "ok", "/b.eml": "ok", "/c.msg": "ok", "/d.doc": "parse_error", "/e.pdf": "backend_missing", "/f.txt": "unsupported", "g.docx": "parse_error"}


def test_none_kept_in_alternate():
    _, grids = parsers.parse_email(mail())
    assert grids == [[["h", "g"], ["1", "none"]]]


def test_round_trips(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, "b é"), (1, 0, "a"), (2, 0, "c")], "doc_id long, chunk_index int, text string")
    files.write_chunks(chunks, f"{tmp_path}/c")
    assert sorted(map(tuple, files.read_chunks(spark, f"{tmp_path}/c").collect())) == [(1, 0, "a"), (1, 1, "b é"), (2, 0, "c")]
    points = embedding.points(embedding.encoded(chunks)).drop("doc_id")
    files.write_points(points, f"{tmp_path}/p")
    assert sorted(map(str, files.read_points(spark, f"{tmp_path}/p").collect())) == sorted(map(str, points.collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_chunks(spark, f"{tmp_path}/none").count()


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    rows = lambda *x: spark.createDataFrame([(1, i, [float(v)] * 2, (f"t{v}", "u", i)) for i, v in x], "doc_id long, id long, vector array<float>, payload struct<text:string,source_file:string,chunk_index:int>")
    assert not s.exists("c") and s.create("c", 2) and s.exists("c") and not s.create("c", 2)
    assert s.upsert("c", rows((0, 1), (1, 1))).count() == 0
    s.upsert("c", rows((1, 5), (2, 2)))
    assert sorted((r.id, r.payload.text) for r in s.points("c").collect()) == [(0, "t1"), (1, "t5"), (2, "t2")]
    bad = s.upsert("c", spark.createDataFrame([(1, 9, [1.0], None), (1, 8, None, None)], rows((0, 0)).schema))
    assert sorted(r.id for r in bad.collect()) == [8, 9]
    s.replace_all("c", rows((7, 7)), 2)
    assert [r.id for r in s.points("c").collect()] == [7]
    s.drop("c")
    assert not s.exists("c")


def test_top_k_ties_and_blocks(spark):
    points = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, vector array<float>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 3.0])], "question_id long, vector array<float>")
    for block in (1, 100):
        got = {(r.question_id, r.rank): (r.id, r.score) for r in retrieval.top_k(points, asked, 2, block).collect()}
        assert got[10, 1] == (1, 1.0) and got[10, 2] == (3, 1.0) and got[11, 1] == (2, 1.0) and got[11, 2] == (1, 0.0)
    assert retrieval.top_k(points, asked.limit(0), 2).count() == 0 and retrieval.top_k(points.limit(0), asked, 2).count() == 0


def test_odd_vectors_lose_no_hits(spark):
    rows = [(k, [1.0, float(k)]) for k in range(4)] + [(10, [1.0, 1.0, 1.0]), (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [None, 1.0]), (14, []), (15, None), (16, [0.0, 0.0])]
    points = spark.createDataFrame(rows, "id long, vector array<float>").withColumn("doc", F.lit(1)).coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 1.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1)], "question_id long, vector array<float>, doc int")
    for scope in (None, "doc"):
        got = {(r.question_id, r.rank): r.id for r in retrieval.top_k(points, asked, 3, scope=scope).collect()}
        assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 1): 3, (2, 2): 2, (2, 3): 1, (3, 1): 10}


def test_questions_meet_their_document_only(spark):
    points = spark.createDataFrame([(d, i, [1.0, float(d * i)]) for d in range(5) for i in range(6)], "doc_id long, id long, vector array<float>")
    asked = spark.createDataFrame([(q, q % 5, [1.0, 2.0]) for q in range(10)], "question_id long, doc_id long, vector array<float>")
    found = retrieval.top_k(points, asked, 2, scope="doc_id", ids=("doc_id", "id"))
    assert {r.question_id % 5 == r.doc_id for r in found.collect()} == {True} and found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    below = plan[plan.rindex("MapInArrow") :]
    assert "Exchange" not in below  # points stay where they are read, only hits are moved


def test_documents_of_any_size_in_both_ways(spark):
    rng = np.random.default_rng(3)
    data = [(0 if k % 3 else k % 7, k, rng.normal(size=4).tolist()) for k in range(600)] + [(None, 900, [1.0] * 4), (5, 901, [1.0] * 3), (6, 902, None)]
    points = spark.createDataFrame(data, "doc_id long, id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(q, q % 9 if q else None, rng.normal(size=4).tolist()) for q in range(60)] + [(70, 5, [1.0] * 3), (71, 5, None)], "question_id long, doc_id long, vector array<double>")
    names, schema = ["question_id", "score", "doc_id", "id"], "question_id long, score double, doc_id long, id long"
    ways = [retrieval.top_k(points, asked, 3, scope="doc_id", ids=("doc_id", "id"))]
    parts = (points.withColumn("_scope", F.col("doc_id")), asked.where("doc_id is not null").withColumn("_scope", F.col("doc_id")).drop("doc_id"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id", "id"))
    ways += [retrieval._dealt(*parts, 3, ("doc_id", "id"), names, schema, block).withColumn("rank", rank).where("rank <= 3").select("question_id", "rank", "score", "doc_id", "id") for block in (7, 8192)]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    expected = set()
    for q in asked.collect():
        hits = sorted((-round(float(unit(v) @ unit(q.vector)), 6), d, i) for d, i, v in data if q.vector and v and d is not None and d == q.doc_id and len(v) == len(q.vector))[:3]
        expected |= {(q.question_id, r + 1, -s, d, i) for r, (s, d, i) in enumerate(hits)}
    for way in ways:
        assert set(map(tuple, way.collect())) == expected


def test_no_cross_join_in_search(spark):
    points = spark.createDataFrame([(3, [1.0, 0.0])], "id long, vector array<float>")
    plan = retrieval.top_k(points, points.withColumnRenamed("id", "question_id"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_self_query_is_first(spark, small):
    points = spark.read.parquet(f"{small}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector")
    first = retrieval.top_k(points, points.withColumnRenamed("id", "question_id"), 1).collect()
    assert len(first) == points.count() and all(r.id == r.question_id and r.score > 0.999 for r in first)


@pytest.mark.parametrize(("text", "answers"), [('["a","b"]', ["a", "b"]), (" [] ", []), ('("a","b")', None), ('["a",1]', None), ('```\n["a"]\n```', None), ('["a"]+["b"]', None), (None, None)])
def test_read_answers(spark, text, answers):
    r = spark.createDataFrame([(text,)], "c string").select(answering.read_answers("c").alias("r")).first().r
    assert r.ok == (answers is not None)
    assert r.answers == answers if answers is not None else r.answers[0].startswith("Error parsing model response: ")


def test_answers_end_to_end(spark):
    docs = spark.createDataFrame([(1, "The sky is blue today. Grass grows green and tall."), (2, "Iron melts in great heat."), (3, None)], "doc_id long, text string")
    points = service.ingest(docs)
    asked = spark.createDataFrame([("r", 0, "What grows green?", 1), ("r", 1, "What is blue?", 1), ("s", 0, "Where does iron melt?", 2), ("s", 1, "Anything here?", 3)], "request_id string, q_pos int, question string, doc_id long")
    got = {(r.request_id, r.q_pos): r.answer for r in service.answer(points, asked).collect()}
    assert got["r", 0] == "Grass grows green and tall." and got["r", 1] == "The sky is blue today." and got["s", 0] == "Iron melts in great heat." and got["s", 1] == retrieval.NOTHING
    told = service.answer(points, asked, generator=lambda: lambda p: '["one", "two"]').collect()
    assert sorted((r.request_id, r.q_pos, r.answer, r.status) for r in told) == [("r", 0, "one", "ok"), ("r", 1, "two", "ok"), ("s", 0, "one", "ok"), ("s", 1, "two", "ok")]
    odd = service.answer(points, asked, generator=lambda: lambda p: '["one"]').collect()
    assert {r.status for r in odd} == {"answer_count_mismatch"} and {r.answer for r in odd if r.q_pos} == {None}
    bad = service.answer(points, asked, generator=lambda: lambda p: "no").collect()
    assert {r.status for r in bad} == {"no_answers"} and all(r.answer.startswith("Error") for r in bad)
    assert {r.doc_id: r.status for r in service.ingest_status(docs, points).collect()} == {1: "ok", 2: "ok", 3: "no_chunks"}


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some text here, really."), (2, "More text there, really.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    s = store.Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        streaming.follow(spark, f"{tmp_path}/in", "doc_id long, text string", s, "c", f"{tmp_path}/check").awaitTermination()
        docs.where("doc_id = 1").withColumn("doc_id", F.col("doc_id") + 9).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.doc_id for r in s.points("c").collect()) == [1, 2, 10]


def test_streams_add_to_what_is_there(spark, tmp_path):
    docs = spark.createDataFrame([(2, "More text there, really.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.create("c", 768)
    assert s.points("c").count() == 0 and s.points("c").columns == ["doc_id", "id", "vector", "payload"]
    s.upsert("c", service.ingest(docs.withColumn("doc_id", F.lit(1).cast("long"))))
    streaming.follow(spark, f"{tmp_path}/in", "doc_id long, text string", s, "c", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.doc_id for r in s.points("c").collect()) == [1, 2]
    names = s.versions("c")
    s.write("c", docs.limit(0), names[1])  # a batch that is repeated
    assert s.versions("c") == names and s.points("c").count() == 2


def test_pdf_by_a_given_backend(spark):
    def backend(content):
        return content.decode(), [[["Plan", None, "Cost"], ["Gold", "yes", "5"], ["", "no", "None"], ["Gold", "yes", "5"]], [["one row"]]]

    files_ = spark.createDataFrame([(1, b"Page one.\n\nPage two.", "pdf")], "doc_id long, content binary, format string")
    parsed = parsers.parsed(files_, {"pdf": backend})
    text = lambda **c: parsers.document_text(parsed, **c).first().doc_text
    # three rows look like a header, so they are one; the last row is the body, cells filled from the left
    assert text() == "Page one. Page two.; Plan Gold: Gold, yes no: yes, Cost 5 None: 5"
    assert text(plain_pdf=True) == "Page one.\n\nPage two."


def test_pdf_bytes():
    import zlib

    cmap = b"1 beginbfchar <0003> <0020> endbfchar 1 beginbfrange <0010> <0012> <0041> <0020> <0021> [<00e9> <d83dde00>] endbfrange"
    body = b"BT /F2 9 Tf <001000110003> Tj 0 -12 Td [<0012> -250 <0020> 30 <0021>] TJ T* /F1 9 Tf (a \\(b\\) \\351\\\n.) Tj (next) ' ET % done"
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 9 0 R]/Count 2>>", b"<</Type/Page/Contents[4 0 R]/Resources 5 0 R>>", b"<</Filter/FlateDecode>>stream\n" + zlib.compress(body) + b"\nendstream", b"<</Font<</F1 6 0 R/F2 7 0 R>>>>", b"<</Type/Font>>", b"<</Type/Font/ToUnicode 8 0 R>>", b"<<>>stream\n" + cmap + b"\nendstream"]
    second = [b"9 0 obj <</Type/Page/Contents 10 0 R>> endobj", b"10 0 obj <</Filter/ASCIIHexDecode>>stream\n" + b"BT (second) Tj ET".hex().encode() + b">\nendstream endobj"]
    file = b"%PDF-1.5\n" + b"".join(b"%d 0 obj %s endobj\n" % (k + 1, o) for k, o in enumerate(objects)) + b"\n".join(second)
    assert pdf.parse(file) == ("AB \nC é😀\na (b) é.\nnext\n\nsecond", [])
    held = b"<</Type/Page/Contents 4 0 R>>"
    stream = zlib.compress(b"3 0 " + held)
    packed = b"%PDF-1.5 1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]>>endobj 4 0 obj<<>>stream\nBT (in) Tj ET\nendstream endobj 5 0 obj<</Type/ObjStm/N 1/First 4/Filter/FlateDecode>>stream\n" + stream + b"\nendstream endobj"
    assert pdf.parse(packed) == ("in", [])
    for bad in (b"", b"junk", b"%PDF-1.4 trailer <</Encrypt 3 0 R>>", b"%PDF-1.4 1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[2 0 R]>>endobj", file.replace(b"/ASCIIHexDecode", b"/DCTDecode")):
        with pytest.raises(ValueError, match="PDF|encrypted|circle|filter"):
            pdf.parse(bad)


def test_merged_rows_of_docx():
    down = lambda t, how: f"<w:tc><w:tcPr><w:vMerge{how}/></w:tcPr>{para(t)}</w:tc>"
    restart = ' w:val="restart"'
    body = f"<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{down('a', restart)}{cell('1')}</w:tr><w:tr>{down('', '')}{cell('2')}</w:tr></w:tbl>"
    assert parsers.parse_docx(docx(body))[1] == [[["k", "v"], ["a", "1"], ["a", "2"]]]


def test_cells_that_a_page_leaves_open():
    assert html.parsed("<table><tr><td>a<tr><td>b</table>later") == ("ablater", [[["a"], ["b"]]])
    assert html.parsed("<table><tr><th>h<th>g<tr><td>1<td>2</tr></table>x</td>y")[1] == [[["h", "g"], ["1", "2"]]]
    assert html.parsed("<table><tr><td>a<table><tr><td>in<tr><td>ner</table>b<td>c<tr><td>d</table>")[1][0][-1] == ["d"]
    assert html.parsed("<table><tr><td>a<table><tr><td>in<tr><td>ner</table>b<td>c<tr><td>d</table>")[1][1] == [["in"], ["ner"]]


def test_entities(spark):
    said = spark.createDataFrame([("caf&eacute;&nbsp;x &euro;5 &#233;&#xe9; &amp;lt; <b>&lt;</b>",), (None,), ("",)], "h string").select(html.html_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in said] == ["café\xa0x €5 éé &lt; <", None, ""]


def test_pieces_of_a_cell_are_stripped():
    assert html.parsed("<table><tr><td>a <b> b</b> </td></tr><tr><td> c</td></tr></table>")[1] == [[["ab"], ["c"]]]


def test_auth(spark):
    row = spark.createDataFrame([("bearer", "t", ""), ("bearer", "x", "k"), (None, None, None)], "a string, b string, c string")
    ask = lambda **c: [r[0] for r in row.select(service.allowed(F.col("a"), F.col("b"), F.col("c"), PipelineConfig(auth_token="t", **c))).collect()]  # noqa: E731, S106
    assert ask() == [True, False, False] and ask(accept_any_api_key=True) == [True, True, False] and ask(auth_enabled=False) == [True] * 3


def test_download(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            found = {"/a.eml": mail(), "/b.docx": BASIC, "/c.doc": b"junk"}.get(self.path.split("?")[0])
            self.send_response(200 if found else 404)
            self.end_headers()
            self.wfile.write(found or b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"
    urls = [f"{top}/a.eml?x=1", f"{top}/b.docx", f"{top}/c.doc", f"{top}/none.pdf", f"{top}/a.eml#part", "file:///etc/hosts.eml", None, "http://127.0.0.1:1/x.eml"]
    rows = spark.createDataFrame([(str(i), u) for i, u in enumerate(urls)], "request_id string, document_url string")
    got = {r.source_file: r for r in service.download(rows).collect()}
    server.shutdown()
    assert [got[u].status for u in urls] == ["ok", "ok", "parse_error", "not_found", "unsupported", "not_found", "not_found", "not_found"]
    assert got[urls[1]].text == "First. Second.; k: 1, k: 2, v: 3" and got[urls[3]].text is None


def test_observed(spark):
    df, seen = service.observed(spark.range(7), "seven")
    df.collect()
    assert seen.get["rows"] == 7


def test_request_times(spark):
    began = time.time() - 5
    answers = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("s", 0, None)], "request_id string, q_pos int, answer string")
    got = {r.request_id: (r.seconds, r.rows) for r in service.request_times(answers, began).collect()}
    assert {k: n for k, (_, n) in got.items()} == {"r": 2, "s": 1} and all(5 <= s < 120 for s, _ in got.values())
    assert service.request_times(answers.limit(0), began).collect() == []


def test_landed_files_as_a_stream(spark, tmp_path):
    source, target, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    source.mkdir()
    timings = landing.Timings()
    spark.streams.addListener(timings)
    try:
        put = lambda **files_: [(source / name.replace("_", ".")).write_bytes(data) for name, data in files_.items()]
        put(a_eml=mail(), b_docx=BASIC, c_txt=b"plain", d_doc=b"junk")
        landing.follow_files(spark, str(source), target, check, files_at_once=3).awaitTermination()
        put(e_docx=BASIC, f_pdf=b"%PDF", g_eml=b"")
        for _ in range(2):  # the second finds nothing new
            query = landing.follow_files(spark, str(source), target, check)
            query.awaitTermination()
        deadline = time.monotonic() + 5
        while sum(r["rows"] for r in timings.rows) < 7 and time.monotonic() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(timings)
    whole = {(r.source_file.rpartition("/")[2], r.status, r.text) for r in service.read_documents(spark, str(source)).collect()}
    good, bad = landing.documents(spark, target), landing.dead_letters(spark, target)
    got = [(r.source_file.rpartition("/")[2], r.status, r.text) for r in good.collect()]
    assert sorted(got) == sorted(x for x in whole if x[1] == "ok") and len(got) == len(set(got))
    assert sorted((r.source_file.rpartition("/")[2], r.status) for r in bad.collect()) == sorted((f, s) for f, s, _ in whole if s != "ok")
    assert {r.source_file.rpartition("/")[2]: r.length for r in bad.collect()} == {"c.txt": 5, "d.doc": 4, "f.pdf": 4}
    assert {r["batch"] for r in timings.rows} >= {0, 1} and all(r["seconds"] > 0 and r["rows"] > 0 for r in timings.rows) and timings.table(spark).count() == len(timings.rows)
    last = max((tmp_path / "check/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # a batch that was not known to be finished is done again, with the same files
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    landing.follow_files(spark, str(source), target, check).awaitTermination()
    assert landing.documents(spark, target).count() == len(got)
