"""Tables as arrays of cells: filling, headers, and rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, strip


def forward_fill(cells: Column) -> Column:
    """Each cell stripped; a blank one repeats the last that is not, or is empty before the first."""
    start = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("last"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(blank(x), s["last"]).otherwise(strip(x))
        return F.struct(F.concat(s["o"], F.array(now)).alias("o"), now.alias("last"))

    return F.aggregate(cells, start, step, lambda s: s["o"])


def is_header(cells: Column, empty: bool = True) -> Column:
    """Whether half of the cells or more are filled; ``empty`` for a row without cells."""
    return F.when(F.size(cells) == 0, F.lit(empty)).otherwise(F.size(F.filter(cells, lambda x: ~blank(x))) * 2 >= F.size(cells))


def header_rows(grid: Column, most: int = 3, empty: bool = True) -> Column:
    """How many rows at the top are the header: up to ``most`` while they look like one, at least one."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    step = lambda s, row: F.struct(F.when(s["go"] & is_header(row, empty), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["go"] & is_header(row, empty)).alias("go"))
    return F.greatest(F.lit(1), F.aggregate(F.slice(grid, 1, most), start, step, lambda s: s["n"]))


def merge_headers(rows: Column, keep_blank: bool = True) -> Column:
    """One header of several rows: each column's cells, top down, joined by a space (T4).

    Null and empty cells are skipped; ``keep_blank``: cells of white space count as empty ones and still add a space.
    """
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    there = (lambda x: x.isNotNull() & (x != "")) if keep_blank else (lambda x: ~blank(x))
    column = lambda k: strip(F.array_join(F.transform(F.filter(F.transform(rows, lambda r: F.get(r, k)), there), strip), " "))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), column)).otherwise(F.array().cast("array<string>"))


def linearised(header: Column, cells: Column, suppress_none: bool = False) -> Column:
    """``h: v, h: v`` of the columns where both are there; null for a ragged row or where nothing is left."""
    pair = lambda h, v: F.when((h != "") & (v != "") & (~F.lit(suppress_none) | (F.lower(strip(v)) != "none")), F.concat(h, F.lit(": "), v))
    row = F.array_join(F.filter(F.zip_with(header, cells, pair), lambda x: x.isNotNull()), ", ")
    return F.when((F.size(header) == F.size(cells)) & ~blank(row), row)


def body_cells(cells: Column) -> Column:
    """Cells of a body row: filled from the left, line feeds as spaces, stripped."""
    return F.transform(forward_fill(cells), lambda x: strip(F.replace(x, F.lit("\n"), F.lit(" "))))


def plain_cells(cells: Column) -> Column:
    return F.transform(cells, lambda x: strip(F.coalesce(x, F.lit(""))))


def table_rows(grid: Column, paged: bool, suppress_none: bool) -> Column:
    """The rows of a table as text (T8 and all above). ``paged``: headers of up to three rows, body rows filled."""
    n = header_rows(grid) if paged else F.lit(1)
    header = forward_fill(merge_headers(F.slice(grid, F.lit(1), n))) if paged else forward_fill(F.get(grid, F.lit(0)))
    cells = body_cells if paged else plain_cells
    made = F.transform(F.slice(grid, n + 1, F.greatest(F.size(grid) - n, F.lit(0))), lambda row: linearised(header, cells(row), suppress_none))
    least = 1 if paged else 0
    return F.when(F.size(grid) > least, F.filter(made, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def first_seen(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",), value: str = "row", order: str = "pos") -> DataFrame:
    """Each different ``value`` of a document once, at its first ``order`` (T6); aggregated before the shuffle."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order))


def assembled(text: Column, rows: Column, terminator: str = "") -> Column:
    """Text, then the rows, all joined by ``; `` (T7). No rows: the text alone."""
    said = F.transform(rows, lambda r: F.concat(r, F.lit(terminator)))
    return F.when(F.size(rows) > 0, F.concat(strip(text), F.lit("; "), F.array_join(said, "; "))).otherwise(strip(text))
