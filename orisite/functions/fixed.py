"""Fixed-width record fields as Column expressions (0-based, end-exclusive like Python slices)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(line: Column | str, start: int, end: int) -> Column:
    """``line[start:end]``; past the end gives a shorter (possibly empty) string, never an error."""
    c = F.col(line) if isinstance(line, str) else line
    return F.substring(c, start + 1, end - start)


def char(line: Column | str, pos: int) -> Column:
    return field(line, pos, pos + 1)


# What the fields may hold besides blanks around it; casts alone would also take spellings such
# as 1.0d, 0x1p3 or NaN.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def int_field(line: Column | str, start: int, end: int) -> Column:
    """Integer field; surrounding blanks allowed, anything unparsable is NULL."""
    f = field(line, start, end)
    return F.when(f.rlike(INTEGER), f.try_cast("int"))


def float_field(line: Column | str, start: int, end: int) -> Column:
    """Decimal number; surrounding blanks allowed, anything else is NULL."""
    f = field(line, start, end)
    return F.when(f.rlike(NUMBER), f.try_cast("double"))
