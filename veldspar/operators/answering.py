"""Prompts, generated answers, and their reading."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .chunking import sentences
from .embedding import words

#: The completion of a prompt.
Generator = Callable[[str], str]

TASK = (
    "Answer each question from its own context passages and from nothing else. Give one formal, complete sentence for each question, "
    "in the order in which they are asked, with every condition, period and clause that the passages state, in their own words where "
    "possible. If the passages do not hold the answer, do not guess. Reply with a list of strings and nothing besides."
)


def prompt(questions: Column, contexts: Column) -> Column:
    """The prompt of a request (R8): ``questions`` in order; ``contexts``: array of struct (question, contexts)."""
    return F.concat(F.lit(TASK + "\n\nContext:\n"), F.to_json(contexts), F.lit("\n\nQuestions:\n"), F.to_json(questions))


def generated(requests: DataFrame, load: Callable[[], Generator]) -> DataFrame:
    """``requests`` (request_id, prompt, ...) with completion, one call each.

    A failed task is run again, so calls can be repeated: give them the request_id where that matters.
    """
    at = requests.columns.index("prompt")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = load()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([generator(p) for p in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, "completion"])

    return requests.mapInArrow(ask, StructType([*requests.schema.fields, StructField("completion", StringType())]))


def chat_model(model: str, temperature: float = 0.2, max_tokens: int = 1024, key: str = "") -> Callable[[], Generator]:
    """A generator over a chat completion client, where one is installed."""

    def load() -> Generator:
        from openai import OpenAI

        client = OpenAI(api_key=key)
        ask = lambda text: client.chat.completions.create(model=model, messages=[{"role": "user", "content": text}], temperature=temperature, max_tokens=max_tokens)
        return lambda text: ask(text).choices[0].message.content

    return load


def extractive(question: Column, context: Column) -> Column:
    """The offline answer: the context's sentence with the most different words of the question, the first of several."""
    asked = F.array_distinct(words(question))
    scored = F.transform(sentences(context), lambda s, k: F.struct(F.size(F.array_intersect(F.array_distinct(words(s)), asked)).alias("n"), (-k).alias("k"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], context)


#: A fixed value: what an answer says where a reply could not be read.
UNREADABLE = "Error parsing model response: "


def _read(content: str | None) -> dict:
    try:
        found = ast.literal_eval((content or "").strip())
        if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
            raise ValueError("the reply is no list of strings")
        return {"answers": found, "ok": True}
    except Exception as e:  # noqa: BLE001  whatever a model replies
        told = re.sub(r" at 0x[0-9a-f]+", "", str(e))  # the same text whenever and wherever it is read
        return {"answers": [UNREADABLE + told], "ok": False}


def read_answers(completion: Column | str) -> Column:
    """A completion as struct (answers, ok): a list of strings (R10), or one text that tells the error (R11). A null completion is empty."""

    @F.arrow_udf("struct<answers:array<string>,ok:boolean>")
    def read(column: pa.Array) -> pa.Array:
        return pa.array([_read(c) for c in column.to_pylist()], pa.struct([("answers", pa.list_(pa.string())), ("ok", pa.bool_())]))

    return read(completion)


def read_json_answers(completion: Column) -> Column:
    """The same for completions that are JSON, without Python; null where it is none."""
    return F.from_json(completion, "array<string>")


def count_status(asked: Column, answers: Column) -> Column:
    """Whether there are as many answers as questions."""
    return F.when(F.size(asked) == F.size(answers), F.lit("ok")).otherwise(F.lit("answer_count_mismatch"))
