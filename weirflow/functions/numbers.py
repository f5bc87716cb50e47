"""Reading numbers that are not always spelled alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, an optional plus sign, leading zeros, then the digits that count.
_DECIMAL = r"^[\s\p{Z}]*\+?0*([0-9]+)[\s\p{Z}]*$"

#: Digits of the length in front of a sortable number; a text is shorter than 10^10 characters.
LENGTH_DIGITS = 10


def _found(column: Column) -> Column:
    """The digits that count, as an array of one or none. Used once in an expression, the text is matched once wherever the planner moves it."""
    return F.regexp_extract_all(column.cast("string"), F.lit(_DECIMAL), F.lit(1))


def canonical_decimal(column: Column) -> Column:
    """The digits of a non-negative whole number without white space, sign and leading zeros; null if it isn't one."""
    return F.get(_found(column), F.lit(0))


def sortable_decimal(column: Column) -> Column:
    """canonical_decimal with its length in front: text that sorts as the numbers do, whatever their length."""
    return F.get(F.transform(_found(column), lambda d: F.concat(F.lpad(F.length(d).cast("string"), LENGTH_DIGITS, "0"), d)), F.lit(0))


def digits_of(sortable: Column) -> Column:
    """The number's digits again, as text."""
    return F.substring(sortable, F.lit(LENGTH_DIGITS + 1), F.length(sortable))


def whole_number(column: Column) -> Column:
    """canonical_decimal as a long where it has at most 18 digits, else null."""
    digits = canonical_decimal(column)
    return F.when(F.length(digits) <= 18, digits.cast("long"))
