"""Column expressions on text that keep to Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and the information separators have it; Java's own class has fewer.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space each, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return text.isNull() | ~text.rlike(f"[^\\s\\x1c-\\x1f\\x85\\p{{Z}}]")
