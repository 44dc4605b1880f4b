"""Validation of uploaded invoice rows: every error of a row, in a fixed order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import messages
from ..functions.dates import date_shaped, upload_date
from ..functions.numbers import number_or_null
from ..functions.text import fill, strip_to_null
from ..schemas import REQUIRED_UPLOAD_COLUMNS
from .common import settle

# Date fields in the order they are checked, messages and statuses.
DATE_COLUMNS = (
    "posting_date",
    "due_date",
    "clear_date",
    "document_create_date",
    "document_create_date_1",
    "baseline_create_date",
)
MISSING = "{row}Missing {name}"
INVALID = "{row}Invalid {name}"
OPEN_FLAG_RANGE = "{row}is_open must be 0 or 1"
MISSING_HEADERS = "Missing required columns: {names}"
MORE_ERRORS = "... {count} more errors"
SHOWN_ERRORS = 20
FIRST_DATA_LINE = 2


def header_errors(names: Iterable[str]) -> list[str]:
    """One message naming every required column the header lacks."""
    present = {name.strip() for name in names if name and name.strip()}
    missing = [name for name in REQUIRED_UPLOAD_COLUMNS if name not in present]
    return [MISSING_HEADERS.format(names=", ".join(missing))] if missing else []


def validate_rows(rows: DataFrame) -> DataFrame:
    """Add ``errors``, the messages of each row; ``row_number`` names it in the text."""
    checked = dict.fromkeys([*REQUIRED_UPLOAD_COLUMNS, *DATE_COLUMNS])
    held = {name: f"__{name}" for name in checked}
    shaped = {name: f"__{name}_shaped" for name in DATE_COLUMNS}

    def given(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    # Stripped text, then parsed numbers and dates, as columns that are computed once.
    staged = rows.withColumns(
        {
            "__row": fill("Row {row}: ", {"row": F.col("row_number").cast("string")}),
            **{held[name]: strip_to_null(given(name)) for name in checked},
            **{shaped[name]: date_shaped(given(name)) for name in DATE_COLUMNS},
        }
    ).withColumns(
        {
            "__amount": number_or_null("__invoice_amount"),
            "__flag": number_or_null("__is_open"),
        }
    )

    def say(template: str, name: str = "") -> Column:
        return fill(template, {"row": F.col("__row"), "name": name})

    text = {name: F.col(column) for name, column in held.items()}
    missing = [(text[name].isNull(), say(MISSING, name)) for name in REQUIRED_UPLOAD_COLUMNS]
    amount, flag = F.col("__amount"), F.col("__flag")
    numbers = [
        (text["invoice_amount"].isNotNull() & amount.isNull(), say(INVALID, "invoice_amount")),
        # The flag counts by its whole part, so anything between -1 and 2 is 0 or 1.
        ((flag <= -1) | (flag >= 2), say(OPEN_FLAG_RANGE)),
        (text["is_open"].isNotNull() & flag.isNull(), say(INVALID, "is_open")),
    ]
    dates = [
        (text[name].isNotNull() & upload_date(shaped[name]).isNull(), say(INVALID, name))
        for name in DATE_COLUMNS
    ]
    found = staged.withColumn("errors", messages([*missing, *numbers, *dates]))
    return settle(found.select(*rows.columns, "errors"), "errors")


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def row_errors(validated: DataFrame) -> DataFrame:
    """One row per error: row number, position within the row, message."""
    return validated.select(
        "row_number", F.posexplode("errors").alias("position", "message")
    )


def validation_totals(validated: DataFrame) -> DataFrame:
    """Row totals, job status and the three-line summary, in one row."""
    totals = validated.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.size("errors") == 0).alias("valid_rows"),
        F.count_if(F.size("errors") > 0).alias("invalid_rows"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("error_count"),
    )
    failed = (F.col("error_count") > 0) & (F.col("valid_rows") == 0)
    return totals.withColumns(
        {
            "status": F.when(failed, "Validation Failed").otherwise("Validated"),
            "validation_summary": fill(
                "Total rows: {total}\nValid rows: {valid}\nInvalid rows: {invalid}",
                {
                    "total": F.col("total_rows").cast("string"),
                    "valid": F.col("valid_rows").cast("string"),
                    "invalid": F.col("invalid_rows").cast("string"),
                },
            ),
        }
    )


def error_summary(errors: DataFrame, limit: int = SHOWN_ERRORS) -> DataFrame:
    """The first messages in row order and how many more there are, as one text."""
    first = errors.orderBy("row_number", "position").limit(limit)
    shown = first.agg(
        F.array_sort(F.collect_list(F.struct("row_number", "position", "message"))).alias("shown")
    )
    total = errors.agg(F.count("*").alias("error_count")).scalar()
    text = F.array_join(F.transform("shown", lambda e: e["message"]), "\n")
    more = F.col("error_count") - F.size("shown")
    rest = fill("\n" + MORE_ERRORS, {"count": more.cast("string")})
    return shown.withColumn("error_count", total).select(
        F.when(more > 0, F.concat(text, rest)).otherwise(text).alias("error_summary"),
        "error_count",
    )
