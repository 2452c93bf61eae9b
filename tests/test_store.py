"""The store: snapshots, buckets, merges; and the index: the same rows as a full scan, less of them read."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.config import PipelineConfig
from veldspar.operators import index, retrieval, store
from veldspar.plans import service

SCHEMA = "doc_id long, id long, vector array<float>, payload struct<text:string,source_file:string,chunk_index:int>"


def rows(spark, *pairs, doc=1):
    return spark.createDataFrame([(doc, i, [float(v)] * 2, (f"t{v}", "u", 0)) for i, v in pairs], SCHEMA)


def held(s, name="c"):
    return sorted((str(r.doc_id), str(r.id), r.payload.text) for r in s.points(name).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merges_stay_few():
    levels, rewritten, most = [], 0, 0
    for _ in range(1000):
        levels.append(0)
        while run := store.merge_next(levels, 8):
            rewritten += 8 ** (levels[run[0]] + 1)
            levels[run[0] :] = [levels[run[0]] + 1]
        most = max(most, len(levels))
    assert most <= 28 and sum(8**n for n in levels) == 1000 and rewritten <= 1000 * 4


def test_many_batches(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", buckets=2, fan=2)
    s.create("c", 2)
    for n in range(9):
        s.write("c", rows(spark, (n % 4, n), (100 + n, n)), "stream", n)
        s.write("c", rows(spark, (n % 4, -1)), "stream", n)  # a batch that is repeated
    assert len(s.versions("c")) <= 4
    assert held(s) == sorted([("1", str(k), f"t{max(n for n in range(9) if n % 4 == k)}") for k in range(4)] + [("1", str(100 + n), f"t{n}") for n in range(9)])
    folders = [p for p in (tmp_path / "c/data").glob("*/_version=*")]
    assert len(folders) <= 2 * 4 + 2 and len(list((tmp_path / "c/snapshots").glob("0*"))) <= 9
    s.write("c", rows(spark, (0, -1)), "stream", 3)  # long merged, and still known
    assert ("1", "0", "t8") in held(s)
    again = store.Store(spark, f"file://{tmp_path}")  # another that opens the same folder
    assert held(again) == held(s)


def test_reading_shuffles_nothing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", buckets=3)
    s.create("c", 2)
    for v in range(3):
        s.upsert("c", rows(spark, *[(i, v) for i in range(v, 20)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        points = s.points("c")
        assert "Exchange" not in plan(points) and plan(points).count("Bucketed: true") == 2
        assert held(s) == sorted(("1", str(i), f"t{min(i, 2)}") for i in range(20))
        assert "Exchange" not in plan(store.latest(spark.table(s._name("c", s._state("c"))), ("_key",), "_version"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_odd_points(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.create("c", 2)
    points = spark.createDataFrame([(None, 1, [1.0, 1.0], None), (None, 1, [2.0, 1.0], None), (1, None, [1.0, 1.0], None), (None, None, [1.0, 1.0], None), (1, 1, [None, 1.0], None)], SCHEMA)
    assert s.upsert("c", points).count() == 0 and s.points("c").count() == 4  # a null is a key as well, and one key is one point
    s.upsert("c", points.select("doc_id", "id", "vector").where("doc_id is null and id = 1"))
    assert s.points("c").count() == 4 and [r.vector for r in s.points("c").where("doc_id is null and id = 1").collect()] == [[2.0, 1.0]]
    with pytest.raises(ValueError, match="more"):
        s.upsert("c", points.withColumn("more", F.lit(1)))
    s.upsert("c", points.limit(0))
    assert s.points("c").count() == 4
    with pytest.raises(ValueError, match="no collection"):
        s.upsert("d", points)


def test_replacing_is_atomic(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.create("c", 2)
    s.upsert("c", rows(spark, *[(i, i) for i in range(10)]))
    fails = rows(spark, (1, 1)).withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        s.replace_all("c", fails, 2)
    assert len(held(s)) == 10
    s.replace_all("c", s.points("c").where("id >= 5"), 2)  # read from what it replaces
    assert [i for _, i, _ in held(s)] == ["5", "6", "7", "8", "9"]
    bad = s.replace_all("c", s.points("c").unionByName(spark.createDataFrame([(1, 3, [1.0], None)], SCHEMA)), 2)
    assert len(held(s)) == 5 and [r.id for r in bad.collect()] == [3]
    s.upsert("c", rows(spark, (7, 70)))
    assert ("1", "7", "t70") in held(s) and s.about("c") == {"dimensions": 2, "metric": "cosine"}


def test_many_writers_lose_nothing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", fan=100)
    s.create("c", 2)
    s.upsert("c", rows(spark, (0, 0)))
    failed = []

    def work(first):
        try:
            for k in range(first, first + 3):
                s.write("c", rows(spark, *((100 * k + i, k) for i in range(20))), f"w{k}")
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(10 * t,)) for t in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(s.versions("c")) == 19 and len(held(s)) == 18 * 20 + 1


def test_another_session_reads_it(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.create("c", 2)
    s.upsert("c", rows(spark, (1, 1)))
    s.upsert("c", rows(spark, (1, 2), (2, 2)))
    there = held(s)
    spark.sql(f"drop table {s._name('c', s._state('c'))}")  # a session that has not declared it
    assert held(store.Store(spark, f"file://{tmp_path}")) == there and len(there) == 2


def test_writers_at_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", fan=100)
    s.create("c", 2)
    s.upsert("c", rows(spark, (0, 0)))
    work = [threading.Thread(target=s.write, args=("c", rows(spark, (k, k)), f"w{k}")) for k in range(1, 5)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert {i for _, i, _ in held(s)} == {"0", "1", "2", "3", "4"} and len(s.versions("c")) == 5
    number, state = s._now("c")
    assert not s._publish("c", number, state)  # a number is given once


# -- index ----------------------------------------------------------------------------------------


def clustered(spark, groups=12, each=40, dimensions=16, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dimensions))
    data = [(g * each + k, (middles[g] + 0.02 * rng.normal(size=dimensions)).tolist()) for g in range(groups) for k in range(each)]
    return spark.createDataFrame(data, "id long, vector array<double>")


def same(ix, points, asked, k):
    got = sorted(map(str, ix.search(asked, k).collect()))
    assert got == sorted(map(str, retrieval.top_k(points, asked, k, ids=ix.ids).collect()))
    return got


def test_index_skips_files(spark, tmp_path):
    points = clustered(spark)
    ix = index.Index.build(points, f"file://{tmp_path}/i", block=16)
    asked = points.where("id % 40 = 7").withColumnRenamed("id", "question_id")
    assert len(same(ix, points, asked, 3)) == 36
    one = ix.visits(asked.where("question_id = 7"))
    assert one["clusters"] == 1 < one["all_clusters"] and one["files"] < one["all_files"] / 4
    all_ = ix.visits(asked)
    assert all_["pairs"] < all_["all_pairs"] / 4
    of_one = ix._visited(spark.createDataFrame([(3, 0.0, 0.1)], "cluster int, low double, high double"))
    run = of_one._jdf.queryExecution()
    run.toRdd().count()
    read = run.executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()
    assert 0 < read < one["all_files"] / 4  # as Spark counts the files that a scan opens
    scan = plan(ix._visited(spark.createDataFrame([(0, 0.0, 0.1)], "cluster int, low double, high double")))
    assert "cluster#" in scan.split("PartitionFilters: ")[1].split("]")[0] and "LessThanOrEqual(distance,0.1)" in scan


def test_index_of_odd_vectors(spark, tmp_path):
    data = [(k, [1.0, float(k)]) for k in range(30)] + [(k, [3.0, 4.0]) for k in range(100, 160)] + [(200, [1.0, 1.0, 1.0]), (201, [float("nan"), 1.0]), (202, [float("inf"), 1.0]), (203, [None, 1.0]), (204, []), (205, None), (206, [0.0, 0.0]), (3, [1.0, 0.5])]
    points = spark.createDataFrame([(d % 3, d, v) for d, v in data], "doc_id long, id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 4.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [-1.0, -2.0])], "question_id long, vector array<double>")
    ix = index.Index.build(points, f"file://{tmp_path}/i", ids=("doc_id", "id"), dimensions=2, block=8)
    for k in (1, 3, 70, 200):
        same(ix, points, asked, k)
    copies = ix.visits(asked.where("question_id = 3"))  # of sixty copies only the first few are met
    assert copies["pairs"] <= 4
    empty = index.Index.build(points.limit(0), f"file://{tmp_path}/e", ids=("doc_id", "id"))
    assert empty.search(asked).collect() == [] and ix.search(asked.limit(0)).collect() == []
    opened = index.Index(spark, f"file://{tmp_path}/i")
    same(opened, points, asked, 2)


def test_answers_by_index(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    config = PipelineConfig(scope="corpus")
    service.ingest(docs, config).write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    ix = index.Index.build(points, f"file://{tmp_path}/i", ids=("doc_id", "id"), dimensions=768)
    asked = spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("item_id as question_id", "text as question")
    plain, by_index = (sorted(map(str, service.hits(points, asked, config, index=i).collect())) for i in (None, ix))
    assert plain == by_index


def test_texts_are_looked_up_in_place(spark, small, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 20")
    service.ingest(docs).write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    asked = spark.createDataFrame([(k, f"What of {k}?", k % 20) for k in range(60)], "question_id long, question string, doc_id long")
    found = service.hits(points, asked)
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    assert not [line for line in plan(found).splitlines() if "Exchange hashpartitioning(doc_id" in line]
    rows = sorted(map(str, found.collect()))
    monkeypatch.setattr(service, "MOST_HITS", 179)
    apart = service.hits(points, asked)
    assert sorted(map(str, apart.collect())) == rows and len(rows) > 60
    assert "hint" not in apart._jdf.queryExecution().analyzed().toString().lower()
