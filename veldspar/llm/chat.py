"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts. Its nested field paths are hashed, and the
hash selects the declarative mapping of that layout, which names where its turns, roles and texts
are. Canonical turns are then rendered by a template whose escapes can be undone exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches

# -- layouts ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns.

    ``turns`` is the path of a list whose items have ``role`` and ``text``, or "" where the record
    is itself one turn, placed by ``order``. Otherwise ``fixed`` lists (role, path) of single texts.
    """

    fields: tuple[str, ...]
    turns: str | None = None
    role: str = ""
    text: str = ""
    order: str = ""
    fixed: tuple[tuple[str, str], ...] = ()


#: The field paths of each layout that is known, and the meaning of its fields.
LAYOUTS: tuple[Mapping, ...] = (
    Mapping(("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping(("dialogue[].speaker", "dialogue[].text"), turns="dialogue", role="speaker", text="text"),
    Mapping(("role", "text", "turn"), turns="", role="role", text="text", order="turn"),
    Mapping(("completion", "prompt"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("question", "response", "system_prompt"), fixed=(("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
)

#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(value: object, path: str = "") -> set[str]:
    """Paths of all leaves; items of a list share one path. An empty list or object is a leaf of no kind."""
    if isinstance(value, dict):
        return {p for key, item in value.items() for p in field_paths(item, f"{path}.{key}" if path else key)}
    if isinstance(value, list):
        return {p for item in value for p in field_paths(item, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths: Iterator[str] | set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: tuple[Mapping, ...] = LAYOUTS) -> dict[str, Mapping]:
    found = {fingerprint(m.fields): m for m in layouts}
    for m in layouts:
        if m.turns:  # a record without turns has the list alone
            found.setdefault(fingerprint({f"{m.turns}[]"}), m)
    return found


def canonical(record: object, known: dict[str, Mapping]) -> list[tuple[int, str, str]] | None:
    """(order, role, text) of each turn, or None for an unknown layout. Nulls are empty strings.

    A place that is no whole number of 64 bits raises ValueError, a text that is no Unicode UnicodeEncodeError.
    """
    mapping = known.get(fingerprint(field_paths(record))) if isinstance(record, dict) else None
    if mapping is None:
        return None
    said = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    named = lambda x: ROLES.get(said(x), said(x))
    if mapping.turns is None:
        return [(k, role, said(record[path])) for k, (role, path) in enumerate(mapping.fixed) if not (path == "input" and not record[path])]
    if mapping.turns == "":
        order = record[mapping.order] if record[mapping.order] is not None else 0
        if type(order) is not int or order.bit_length() > 63:
            raise ValueError("no place of a turn")
        return [(order, named(record[mapping.role]), said(record[mapping.text]))]
    return [(k, named(item[mapping.role]), said(item[mapping.text])) for k, item in enumerate(record[mapping.turns])]


TURNS = "conv_id long, turn long, role string, text string, layout string"
UNKNOWN = "unknown"


def to_turns(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of ``records`` (conv_id, record: JSON text): conv_id, turn, role, text, layout.

    layout is the record's fingerprint. A record that is null, no JSON object, or of an unknown
    layout gives one row with a null role, its own text, and ``unknown`` in layout's place: that is
    for ``rejected``, and is not formatted. So does one whose turn is no whole number of 64 bits, whose
    texts hold half a surrogate pair, or that is nested too deeply to be read. A record without turns gives no row. Texts are read whole,
    however long; records that repeat, or share a conv_id or have none, give their turns each. No
    records: no rows.
    """
    small_batches(records.sparkSession)

    @frugal
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        for batch in batches:
            out: list[tuple] = []
            for conv_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text else None
                    turns = canonical(record, known)
                    rows = None if turns is None else [(conv_id, *turn, fingerprint(field_paths(record))) for turn in turns]
                    for row in rows or ():
                        f"{row[2]}{row[3]}".encode()
                except (ValueError, TypeError, KeyError, RecursionError):
                    rows = None
                out += [(conv_id, 0, None, text, UNKNOWN)] if rows is None else rows
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")).mapInArrow(convert, TURNS)


def rejected(turns: DataFrame) -> DataFrame:
    """(conv_id, record) of what ``to_turns`` could not read: a row for each such record."""
    return turns.where(F.col("layout") == UNKNOWN).select("conv_id", F.col("text").alias("record"))


# -- template -----------------------------------------------------------------------------------

#: The marks around a turn: ``### role: text</turn>`` and a line feed.
BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"


def escape(text: str) -> str:
    """Text in which neither ``##`` nor ``</turn>`` is left: a backslash breaks them up."""
    return re.sub(r"#(?=#)", r"#\\", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and where its escaped text begins and ends there."""
    head = BEGIN + escape(role).replace(":", "\\:") + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.DOTALL)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text, escapes undone."""
    at = 0
    while at < len(formatted):
        head = HEAD.match(formatted, at)
        end = formatted.find(END, at)
        if head is None or end < head.end():
            raise ValueError("not a formatted conversation")
        yield unescape(head[1]), unescape(formatted[head.end() : end])
        at = end + len(END)


FORMATTED = "conv_id long, segment long, formatted string, loss array<struct<begin:long,end:long>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _streamed(step: Callable, schema: list[pa.Field], finish: Callable[[object, int], tuple]) -> Callable:
    """A mapInArrow function for rows in order of conv_id: ``step`` adds a row to the state and gives rows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and state["id"] != row[0]:
                    out += finish(state)
                    state = None
                state = state or {"id": row[0]}
                out += step(state, row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(schema), schema, strict=True)], [f.name for f in schema])
        out = finish(state) if state else []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(schema), schema, strict=True)], [f.name for f in schema])

    return stream


def format_turns(turns: DataFrame, trained: str = "assistant", segment_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations: conv_id, segment, formatted text, loss spans in it (texts of ``trained``).

    Turns are in order of (turn, role, text), repeated rows included; null roles and texts are
    empty. A long conversation has several segments, each of whole turns and of about
    ``segment_chars`` at most, so that no row and no task's memory grows with a conversation. Rows
    leave sorted by (conv_id, segment) in partitions that hold whole conversations. Records of an
    unknown layout are left to ``rejected``. No turns: no rows.
    """
    small_batches(turns.sparkSession)
    if "layout" in turns.columns:
        turns = turns.where(F.coalesce("layout", F.lit("")) != UNKNOWN)

    def segment(state: dict) -> list[tuple]:
        if not state.get("parts"):
            return []
        row = (state["id"], state.setdefault("n", 0), "".join(state["parts"]), [{"begin": a, "end": b} for a, b in state["spans"]])
        state |= {"n": state["n"] + 1, "parts": [], "spans": [], "size": 0}
        return [row]

    def step(state: dict, row: tuple) -> list[tuple]:
        text, begin, end = render(row[2] or "", row[3] or "")
        out = segment(state) if state.get("size", 0) + len(text) > segment_chars else []
        at = state.setdefault("size", 0)
        state.setdefault("parts", []).append(text)
        state.setdefault("spans", [])
        if row[2] == trained:
            state["spans"].append((at + begin, at + end))
        state["size"] += len(text)
        return out

    schema = [pa.field("conv_id", pa.int64()), pa.field("segment", pa.int64()), pa.field("formatted", pa.string()), pa.field("loss", _SPANS)]
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_streamed(step, schema, segment), FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as ``format_turns`` leaves them: a row for each.

    Turns are parsed out of the text and their escapes undone; what the loss spans cover is
    unescaped likewise. A digest is fed segment by segment, whatever the conversation's length. A null
    conv_id is one conversation; turns that repeat count each, and empty texts as turns; rows of one conversation
    have to follow one another, as they leave ``format_turns``. Other columns are not read. No rows: no rows.
    """

    def step(state: dict, row: tuple) -> list[tuple]:
        if "turns" not in state:
            state |= {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0}
        for role, text in read_turns(row[2]):
            state["turns"].update(f"{role}\n{text}\n".encode())
            state["n"] += 1
        for span in row[3]:
            text = unescape(row[2][span["begin"] : span["end"]])
            state["loss"].update(text.encode())
            state["loss_chars"] += len(text)
        state["chars"] += len(row[2])
        return []

    def finish(state: dict) -> list[tuple]:
        return [(state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = [pa.field(n.split()[0], k) for n, k in zip(DIGESTS.split(", "), kinds, strict=True)]
    return formatted.mapInArrow(_streamed(step, schema, finish), DIGESTS)


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as JSON records of the layout with one turn each."""
    return conversations.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
