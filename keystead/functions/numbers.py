"""Number helpers with Python-compatible rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def py_round(x: Column, digits: int) -> Column:
    """Round the exact binary value half-to-even, as Python's ``round`` does.

    Spark's ``round``/``bround`` work on the shortest decimal text of a double,
    so 2.675 becomes 2.68 there; the formatter behind ``format_number`` looks at
    the exact value (2.67).
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern)).cast("double")


def money(x: Column) -> Column:
    """``1234.5`` -> ``'1,234'`` (half-even, like Python's ``,.0f``)."""
    return F.format_number(x.cast("double"), 0)


def int_trunc(x: Column) -> Column:
    """Truncate towards zero like Python's ``int``."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")


_FLOAT_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def float_text(c: Column) -> Column:
    """Whole text as a double, NULL when it is not a plain number."""
    t = strip(c)
    return F.when(t.rlike(_FLOAT_TEXT), t.try_cast("double"))


# The characters Python's ``str.strip`` removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` drops only blanks)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_float(c: Column) -> Column:
    """Lenient text to double."""
    return float_text(c.cast("string"))


def safe_int(c: Column) -> Column:
    """Lenient text to whole number, truncated (``'2.9'`` -> 2)."""
    return safe_float(c).try_cast("bigint")
