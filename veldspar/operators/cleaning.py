"""Rule-based cleaning of document text.

A document's lines stay together in one array, so nothing is shuffled: what passes one alternation of
the noise rules is sorted, so that repeated lines stand together, and put in order again.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, squeeze, strip

#: Fixed values: (rule, name, pattern). A line in which one is found, whatever the case, is dropped whole.
NOISE: tuple[tuple[int, str, str], ...] = (
    (1, "uin", r"UIN[:\-\s]*[A-Z0-9]+"),
    (2, "registration_number", r"Reg\.?\s*No\.?\s*[:\-\s]*\d+"),
    (3, "cin", r"CIN\s*[:\-\s]*[A-Z0-9]+"),
    (4, "regulator_number", r"IRDAI\s*Regn?\.?\s*No\.?\s*[:\-\s]*\d+"),
    (5, "page_of", r"Page\s+\d+\s+of\s+\d+"),
    (6, "digits_only", r"^\d+\s*$"),
    (7, "web_address", r"www\.[a-zA-Z0-9\-\.]+\.com"),
    (8, "email", r"E-mail:\s*[a-zA-Z0-9\-\.@]+"),
    (9, "call_at", r"Call at:\s*.*?\(Toll Free.*?\)"),
    (10, "more_details", r"For more details.*?Toll Free.*?\)"),
    (11, "head_office", r"Regd\.?\s*&\s*Head Office:.*?-\s*\d{6}"),
    (12, "plot", r"Plot no\..*?-\s*\d{6}"),
    (13, "capitals_only", r"^[A-Z\s]{10,}\s*$"),
)

#: Fixed values: (what is read, what it becomes), one after the other.
OCR_LITERALS: tuple[tuple[str, str], ...] = (
    (" . ", ". "), (" , ", ", "), (" ; ", "; "), (" : ", ": "), ("( ", "("), (" )", ")"), (" / ", "/"), ("O ", "0 "), ("l ", "1 "), ("  ", " "),
)

REPEATS, LONGER_THAN = 3, 10


def noise_pattern(rule: int, strict: bool = False) -> str:
    """A rule as a Java pattern; strict: case matters, and a match is a word."""
    pattern = NOISE[rule - 1][2]
    if not strict:
        return f"(?iuU)(?:{pattern})"
    return f"(?U)(?:{pattern})" if pattern.startswith("^") else rf"(?U)\b(?:{pattern})"


def any_noise(strict: bool = False) -> str:
    """All rules as one pattern. Those that may begin anywhere, each with three characters as they stand, are only tried where three follow that may begin one."""
    if strict:
        return "|".join(noise_pattern(rule, strict) for rule, _, _ in NOISE)
    ahead, anywhere = ([p for _, _, p in NOISE if p.startswith("^") == at] for at in (True, False))
    begins = "".join(f"[{re.escape(''.join(sorted({p[k].lower() for p in anywhere})))}]" for k in range(3))
    return f"(?iuU)(?:{'|'.join(ahead)}|(?={begins})(?:{'|'.join(anywhere)}))"


def lines(text: Column) -> Column:
    """The text's lines, stripped (C1). Most have no white space at either end and are not searched for it."""
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(SPACE)
    return F.transform(F.split(text, "\n"), lambda x: F.when(ends(x), strip(x)).otherwise(x))


def repeated_lines(stripped: Column) -> Column:
    """Lines of more than ten characters that occur three times or more in one document."""
    long = F.sort_array(F.filter(stripped, lambda x: F.length(x) > LONGER_THAN))
    return F.array_distinct(F.transform(F.filter(F.arrays_zip(long.alias("x"), F.slice(F.concat(long, F.array(F.lit(None), F.lit(None))), REPEATS, F.size(long)).alias("y")), lambda p: p["x"] == p["y"]), lambda p: p["x"]))


def kept(docs: DataFrame, strict: bool = False) -> DataFrame:
    """``docs`` with the column ``kept``: (i, x) of the lines that are neither blank, nor repeated, nor noise, in order.

    Once sorted, a repeated line has itself beside it, so a document costs its number of lines times the
    logarithm. ``_sorted`` is a column that is read more than once: inside a lambda, where it is read once,
    Spark would sort again for each line.
    """
    own = F.filter(F.transform(lines(F.col("text")), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: (p["x"] != "") & ~p["x"].rlike(any_noise(strict)))
    s, none = F.col("_sorted"), F.lit(None).cast("struct<x:string,i:int>")
    near = range(1, REPEATS)
    beside = [s.alias("p"), *[F.concat(F.array_repeat(none, k), s).alias(f"b{k}") for k in near], *[F.slice(s, k + 1, F.size(s)).alias(f"f{k}") for k in near]]
    same = lambda z, side, k: F.coalesce(z[f"{side}{k}"]["x"] == z["p"]["x"], F.lit(False)) if k else F.lit(True)
    many = lambda z: reduce(or_, [same(z, "b", k) & same(z, "f", REPEATS - 1 - k) for k in range(REPEATS)])
    rare = F.filter(F.arrays_zip(*beside), lambda z: z["p"].isNotNull() & ((F.length(z["p"]["x"]) <= LONGER_THAN) | ~many(z)))
    return docs.withColumn("_sorted", F.sort_array(own)).withColumn("kept", F.sort_array(F.transform(rare, lambda z: F.struct(z["p"]["i"].alias("i"), z["p"]["x"].alias("x"))))).drop("_sorted")


def kept_lines(docs: DataFrame, strict: bool = False) -> DataFrame:
    """``docs`` with the column ``lines``: what is kept, without its place."""
    return kept(docs, strict).withColumn("lines", F.transform("kept", lambda p: p["x"])).drop("kept")


def kept_line_rows(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, line_no, line): what ``kept_lines`` keeps of lines that are rows, for documents of any length.

    Repeated lines are counted by document and line, combined before the shuffle, so no row, group or task holds a document.
    """
    own = rows.select("doc_id", "line_no", strip(F.col("line")).alias("line")).where("line <> ''").where(~F.col("line").rlike(any_noise(strict)))
    many = own.where(F.length("line") > LONGER_THAN).groupBy("doc_id", "line").count().where(F.col("count") >= REPEATS).select(F.col("doc_id").alias("of"), F.col("line").alias("again"))
    return own.join(many, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("line") == F.col("again")), "left_anti")


def ocr_literals(text: Column) -> Column:
    """Ten literal corrections, in order."""
    for wrong, right in OCR_LITERALS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def zero_to_letter(text: Column) -> Column:
    """A 0 of its own before a letter becomes O."""
    return F.regexp_replace(text, r"(?U)\b0\b(?=\s*[a-zA-Z])", "O")


def letter_to_one(text: Column) -> Column:
    """An l of its own before a digit becomes 1."""
    return F.regexp_replace(text, r"(?U)\bl\b(?=\s*\d)", "1")


def clean(docs: DataFrame, strict_noise: bool = False, ocr_fixes: bool = True) -> DataFrame:
    """``docs`` with ``cleaned`` beside its columns (C10); a null text is cleaned to the empty one."""
    joined = F.array_join("lines", " ")
    fixed = letter_to_one(zero_to_letter(ocr_literals(joined))) if ocr_fixes else joined
    return kept_lines(docs, strict_noise).withColumn("cleaned", F.coalesce(squeeze(fixed), F.lit(""))).drop("lines")


def noise_hits(docs: DataFrame) -> DataFrame:
    """(rule_id, rule, n_lines): the stripped, non-blank lines in which each rule is found."""
    found = docs.select(F.explode(F.filter(lines(F.col("text")), lambda x: x != "")).alias("line"))
    counts = found.agg(*[F.count_if(F.col("line").rlike(noise_pattern(r))).alias(str(r)) for r, _, _ in NOISE])
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(n).alias("rule"), F.col(str(r)).alias("n_lines")) for r, n, _ in NOISE])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
