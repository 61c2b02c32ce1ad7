"""Number and name formatting used in alert texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """``1234567.8`` as ``1,234,567.80``."""
    return F.format_string("%,.2f", col(c).cast("double"))


def plain(c: str | Column) -> Column:
    """A double without exponent, with ``.0`` when whole."""
    value = col(c).cast("double")
    whole = F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    exact = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), "0+$", "")
    return F.when(value == F.floor(value), whole).otherwise(exact)


WHOLE = r"^[+-]?\d+$"
REAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|^(?i)[+-]?(?:nan|inf|infinity)$"


def to_number(text: Column, kind: str = "double") -> Column:
    """Text as a number, null when it has not the shape of one.

    The shape is tested first: a cast that fails is slow, and casts also accept suffixes such as ``5d``.
    """
    return F.when(text.rlike(WHOLE if kind == "bigint" else REAL), text.try_cast(kind))


def display_id(c: str | Column) -> Column:
    """A10: the id without its dataset prefix, i.e. without everything up to the first underscore."""
    return F.regexp_replace(col(c), "^[^_]*_", "")


def title(c: str | Column) -> Column:
    """``transaction_amount`` as ``Transaction Amount``."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))
