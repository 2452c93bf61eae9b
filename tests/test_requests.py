"""Requests as a stream against the batch answer."""

import datetime as dt

import pytest

from veldspar.plans import service
from veldspar.streaming import requests

pytest.importorskip("google.protobuf")  # stateful processors talk to the engine by it

DOCS = [(1, "The sky is blue today. Grass grows green and tall."), (2, "Iron melts in great heat. Water boils in less."), (3, "Nobody asks of this.")]
ASKED = {"a": (1, ["What grows green?", "What is blue?"]), "b": (2, ["Where does iron melt?"]), "c": (1, []), "d": (2, ["What boils?"])}


def at(second):
    return dt.datetime(2024, 5, 1) + dt.timedelta(seconds=second)


def test_requests_are_answered_once(spark, tmp_path):
    service.ingest(spark.createDataFrame(DOCS, "doc_id long, text string")).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    source, target, check = f"{tmp_path}/events", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    asked = lambda r, s: (r, "asked", *ASKED.get(r, (9, ["lost?"])), at(s))
    there = lambda r, s: (r, "ingested", None, None, at(s))
    steps = [
        [asked("a", 0), there("b", 1), asked("a", 2), asked("late", 3), (None, "asked", 1, ["x"], at(1))],  # b's document is there before it is asked
        [there("a", 4), asked("b", 5), there("b", 5), asked("c", 6)],
        [asked("a", 7), there("a", 7), there("c", 8), there("orphan", 9)],  # repeated: nothing new
        [asked("d", 60), there("d", 61)],  # the clock goes on: late and orphan have waited too long
        [there("late", 62), asked("d", 63), asked("e", 100)],
    ]
    for rows in steps:
        spark.createDataFrame(rows, requests.EVENTS).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(requests.EVENTS).parquet(source)
        requests.answer_stream(events, lambda: points, target, check, patience=20_000).awaitTermination()
    got = sorted(map(str, requests.answers(spark, target).where("status <> 'timed_out'").collect()))
    questions = [(r, k, q, d) for r, (d, qs) in ASKED.items() for k, q in enumerate(qs)]
    batch = service.answer(points, spark.createDataFrame(questions, "request_id string, q_pos int, question string, doc_id long"))
    assert got == sorted(map(str, batch.select("request_id", "q_pos", "question", "answer", "status").collect())) and len(got) == 4
    timed_out = [r.request_id for r in requests.answers(spark, target).where("status = 'timed_out'").collect()]
    assert sorted(timed_out) == ["late", "orphan"]
    assert spark.conf.get(requests.PROVIDER) != requests.ROCKS
