"""Documents as text and table grids: e-mail, DOCX, HTML and PDF (by a plugged-in backend)."""

from __future__ import annotations

import email
import email.policy
import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.slices import sliced
from .cleaning import clean
from .tables import assembled, table_rows

#: (text, grids) of a file's bytes.
Parser = Callable[[bytes], tuple[str, list[list[list[str]]]]]

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"  # a fixed value: the XML namespace


class BackendMissing(RuntimeError):
    """No library for this format is installed, and none was given."""


def parse_email(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """Every text/plain part, and the text and tables of every text/html part, in order; other parts are skipped (P5, P10)."""
    parts, grids = [], []
    for part in email.message_from_bytes(content, policy=email.policy.default).walk():
        kind = part.get_content_type()
        if kind not in ("text/plain", "text/html"):
            continue
        body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
        if kind == "text/html":
            body, found = html.parsed(body)
            grids += found
        parts.append(body)
    return "\n".join(parts), grids


def _said(node: ET.Element) -> str:
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{WORD}t" else marks.get(x.tag, "") for x in node.iter())


def parse_docx(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """Body paragraphs that are not blank, a line each (P3, P9), and every table; merged cells repeat over the columns and rows they span."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
    text = [t for p in body.findall(f"{WORD}p") if (t := _said(p)).strip()]
    grids = []
    for table in body.findall(f"{WORD}tbl"):
        grid = []
        for row in table.findall(f"{WORD}tr"):
            cells: list[str] = []
            for cell in row.findall(f"{WORD}tc"):
                span, merge = cell.find(f"{WORD}tcPr/{WORD}gridSpan"), cell.find(f"{WORD}tcPr/{WORD}vMerge")
                said = "\n".join(_said(p) for p in cell.findall(f"{WORD}p")).strip()
                if merge is not None and merge.get(f"{WORD}val", "continue") == "continue" and grid and len(cells) < len(grid[-1]):
                    said = grid[-1][len(cells)]
                cells += [said] * (int(span.get(f"{WORD}val")) if span is not None else 1)
            grid.append(cells)
        if not grid:
            raise ValueError("a table without rows")
        grids.append(grid)
    return "\n".join(text), grids


def parse_html(content: bytes) -> tuple[str, list[list[list[str]]]]:
    return html.parsed(content.decode("utf-8", "replace"))


def parse_pdf(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """Pages' texts, a blank line between them, and their tables, if a PDF library is installed."""
    try:
        import fitz
        import pdfplumber
    except ImportError as missing:
        raise BackendMissing(str(missing)) from None
    with fitz.open(stream=content, filetype="pdf") as pages:
        text = "\n\n".join(page.get_text("text") for page in pages)
    with pdfplumber.open(io.BytesIO(content)) as pages:
        grids = [[list(row) for row in table] for page in pages.pages for table in page.extract_tables()]
    return text, grids


#: The formats of each dispatch, by extension.
ACTIVE = {"pdf": "pdf", "docx": "docx", "doc": "docx", "eml": "email", "msg": "email"}
STRICT = {"pdf": "pdf", "docx": "docx", "eml": "email"}
PARSERS: dict[str, Parser] = {"pdf": parse_pdf, "docx": parse_docx, "email": parse_email, "html": parse_html}


def parsed(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``files`` (content, format) with text, tables and status beside the other columns; content is dropped.

    status: ok, unsupported (no format), backend_missing, or parse_error. Only ok has a text.
    """
    known = PARSERS | (parsers or {})

    @F.arrow_udf("struct<text:string,tables:array<array<array<string>>>,status:string>")
    def parse(content, kind):  # noqa: ANN001, ANN202
        import pyarrow as pa

        def one(data: bytes | None, kind: str | None) -> dict:
            if kind not in known:
                return {"text": None, "tables": [], "status": "unsupported"}
            try:
                text, grids = known[kind](data or b"")
                return {"text": text, "tables": grids, "status": "ok"}
            except BackendMissing:
                return {"text": None, "tables": [], "status": "backend_missing"}
            except Exception:  # noqa: BLE001  any damage to the file
                return {"text": None, "tables": [], "status": "parse_error"}

        kinds = pa.struct([("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("status", pa.string())])
        return sliced(one, kinds, content, kind)

    return files.withColumn("_p", parse("content", "format")).select(*[c for c in files.columns if c != "content"], "_p.*")


def document_text(parsed_docs: DataFrame, suppress_none: bool = True, terminator: str = "", plain_pdf: bool = False) -> DataFrame:
    """``doc_text``: cleaned text with the table rows behind it. Only text is cleaned; a PDF's rows come once each.

    ``plain_pdf``: a PDF's text as its library gives it, neither cleaned nor with tables (P1).
    """
    rows = lambda paged: F.flatten(F.transform("tables", lambda g: table_rows(g, paged, suppress_none)))
    cleaned, pdf = clean(parsed_docs), F.col("format") == "pdf"
    whole = assembled(F.col("cleaned"), F.when(pdf, F.array_distinct(rows(True))).otherwise(rows(False)), terminator)
    return cleaned.withColumn("doc_text", F.when(pdf, F.col("text")).otherwise(whole) if plain_pdf else whole).drop("cleaned", "tables", "text")


def format_of(extension: Column, strict: bool = False) -> Column:
    """The parser of an extension (S5); null where there is none. ``strict``: modern formats only."""
    known = STRICT if strict else ACTIVE
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[extension]
