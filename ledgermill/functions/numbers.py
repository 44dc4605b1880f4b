"""Number expressions: lenient parsing, exact decimal rounding and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

# Fixed patterns: a whole numeric text, and the longest numeric start of a text.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NUMBER_START = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def number_or_null(c: Column | str) -> Column:
    """Text to DOUBLE; anything that is not a finite decimal number becomes NULL."""
    text = column(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def amount_digits(c: Column | str) -> Column:
    """Number text without thousands commas, currency and percent signs; (x) becomes -x."""
    plain = F.translate(column(c), "\u00a0,£%", " ")
    return F.regexp_replace(plain, r"^\s*\((.*)\)\s*$", "-$1")


def amount_text(c: Column | str) -> Column:
    """The number in such a text, NULL when there is none."""
    return number_or_null(amount_digits(c))


def leading_real(c: Column | str) -> Column:
    """SQLite's text-to-REAL cast: the numeric start of the text, 0 when there is none."""
    text = column(c)
    start = F.regexp_extract(text, NUMBER_START, 1)
    return F.when(text.isNotNull(), F.coalesce(start.try_cast("double"), F.lit(0.0)))


def truncated_int(c: Column | str) -> Column:
    """Text to INT through DOUBLE, cutting the fraction; NULL when blank or not a number."""
    return number_or_null(c).try_cast("int")


def whole_text(value: Column) -> Column:
    """A number printed without decimals; NULL prints as 0."""
    return fixed_text(F.coalesce(value, F.lit(0.0)), 0)


def fixed_text(value: Column, places: int) -> Column:
    """A number printed with fixed decimals, rounding half-even on its binary value."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def rounded(value: Column, places: int) -> Column:
    """Half-even rounding on the binary value, as a DOUBLE."""
    return fixed_text(value, places).cast("double")


def ratio(numerator: Column, denominator: Column, places: int = 6) -> Column:
    """Rounded ratio; NULL when a side is missing or the denominator is 0."""
    return rounded(F.try_divide(numerator, denominator), places)


def clamp(value: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (greatest and least alone would skip it)."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)
