"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column, strip

# The date forms accepted in uploads after year-month-day, tried in this order.
OTHER_DATE_FORMATS = ("d-M-yyyy", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d")
# The shape each of those forms must have (four-digit year, one or two digits else).
UPLOAD_DATE_SHAPE = (
    r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})$"
)
# Fixed patterns: month 1-12 and day 1-31 in the two written forms.
ISO_DAY = "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
COMPACT_DAY = "^[0-9]{4}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$"
# Fixed pattern: the integer start of a text, without leading zeros.
COMPACT_NUMBER = r"^\s*\+?0*([0-9]+)"


def date_shaped(c: Column | str) -> Column:
    """Stripped text that has the shape of an upload date, else NULL."""
    text = strip(c)
    return F.when(text.rlike(UPLOAD_DATE_SHAPE), text)


def upload_date(shaped: Column | str) -> Column:
    """The first upload form that parses; month-first wins over day-first.

    Takes ``date_shaped`` text, best as a column of its own so it is computed once. Year-month-day,
    the usual form, goes through the plain cast, which is much faster than a format parser.
    """
    text = column(shaped)
    others = [F.try_to_date(text, form) for form in OTHER_DATE_FORMATS]
    return F.coalesce(text.try_cast("date"), *others)


def iso_date(c: Column | str) -> Column:
    """Year-month-day text with a four-digit year, else NULL."""
    text = column(c)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text.try_cast("date"))


def compact_digits(text: Column) -> Column:
    """The eight digits of a date written as a number, possibly with a trailing ``.0``.

    Shorter numbers are zero-padded and longer ones cut, as a ``%08d`` print would slice them.
    """
    return F.lpad(F.regexp_extract(text, COMPACT_NUMBER, 1), 8, "0")


def rolling_date(text: Column, month_at: int, day_at: int, shape: str) -> Column:
    """A date from its digits; days 1-31 pass in any month and run over into the next, as
    SQLite dates do. The shape already bounds month and day."""
    year = F.substring(text, 1, 4).try_cast("int")
    month = F.substring(text, month_at, 2).try_cast("int")
    day = F.substring(text, day_at, 2).try_cast("int")
    return F.when(
        text.rlike(shape), F.date_add(F.make_date(year, month, F.lit(1)), day - F.lit(1))
    )


def rolling_iso_date(head: Column) -> Column:
    """From the first ten characters of a timestamp-like text."""
    return rolling_date(head, 6, 9, ISO_DAY)


def rolling_compact_date(digits: Column) -> Column:
    """From ``compact_digits``."""
    return rolling_date(digits, 5, 7, COMPACT_DAY)


def days_past(due: Column, as_of: Column) -> Column:
    """Whole days past the due date, never negative; 0 when there is no due date."""
    return F.when(due.isNotNull(), F.greatest(F.datediff(as_of, due), F.lit(0))).otherwise(F.lit(0))
