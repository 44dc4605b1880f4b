"""Import of cleaned invoice rows: typed fields and merging into the stored tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import first_match, messages
from ..functions.dates import date_shaped, days_past, upload_date
from ..functions.numbers import number_or_null, truncated_int
from ..functions.text import strip, strip_to_null
from ..schemas import CUSTOMERS, INVOICES, MONEY, conform

# Fixed values.
DEFAULT_AS_OF = "2020-05-31"
OPEN, OVERDUE, CLOSED = "Open", "Overdue", "Closed"
UNKNOWN, LATE, ON_TIME = "Unknown", "Late", "On Time"
WHOLE_NUMBERS = ("business_year", "posting_id", "payment_delay_days", "is_late")


def invoice_status(is_open: Column, days_overdue: Column) -> Column:
    return first_match([(~is_open, CLOSED), (days_overdue > 0, OVERDUE)], OPEN)


def late_payment_status(is_open: Column, is_late: Column) -> Column:
    """A closed invoice without a late flag counts as on time."""
    return first_match([(is_open, UNKNOWN), (is_late == 1, LATE)], ON_TIME)


def normalize_rows(rows: DataFrame, as_of: date | str = DEFAULT_AS_OF) -> DataFrame:
    """Cleaned text rows as typed invoice rows; ``row_number`` is kept for ordering."""

    def raw(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    texts = [
        "business_code", "customer_id", "customer_name", "doc_id", "currency",
        "document_type", "payment_terms", "invoice_id",
    ]
    dates = [
        "clear_date", "posting_date", "document_create_date", "document_create_date_1",
        "due_date", "baseline_create_date",
    ]
    shaped = rows.withColumns({f"__{name}": date_shaped(raw(name)) for name in dates})
    typed = shaped.select(
        "row_number",
        *[strip_to_null(raw(name)).alias(name) for name in texts],
        *[upload_date(f"__{name}").alias(name) for name in dates],
        *[truncated_int(strip(raw(name))).alias(name) for name in WHOLE_NUMBERS],
        F.coalesce(number_or_null(strip(raw("invoice_amount"))), F.lit(0.0)).cast(MONEY).alias("invoice_amount"),
        (F.coalesce(truncated_int(strip(raw("is_open"))), F.lit(0)) == 1).alias("open_now"),
    )
    opened = F.col("open_now")
    overdue = F.when(opened, days_past(F.col("due_date"), F.lit(as_of).cast("date"))).otherwise(F.lit(0))
    return (
        typed.withColumn("days_overdue", overdue)
        .withColumns(
            {
                "is_open": opened.cast("int"),
                "late_payment_status": late_payment_status(opened, F.col("is_late")),
                "status": invoice_status(opened, F.col("days_overdue")),
            }
        )
        .drop("open_now", "is_late")
    )


def import_problems(rows: DataFrame) -> DataFrame:
    """All rows with ``problems``: no key, or text where a number belongs; empty if there are none."""
    tests = [
        (strip_to_null("customer_id").isNull(), "Cannot import row without customer_id"),
        (strip_to_null("invoice_id").isNull(), "Cannot import row without invoice_id"),
    ]
    for name in (*WHOLE_NUMBERS, "invoice_amount", "is_open"):
        if name in rows.columns:
            text = strip_to_null(name)
            tests.append((text.isNotNull() & number_or_null(text).isNull(), f"Invalid {name}"))
    return rows.withColumn("problems", messages(tests))


def last_row_per_key(rows: DataFrame, key: str, order: str = "row_number") -> DataFrame:
    """The last row of each key in file order (``order`` is unique per row).

    One aggregate keeps, for each key, the whole row with the largest ``order`` (max_by of the
    row); it is combined before the shuffle, so a key that repeats very often is reduced on the
    map side, and the rows need no second shuffle to be fetched back.
    """
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last"))
    return last.select(key, *[F.col(f"_last.`{c}`").alias(c) for c in others]).select(*rows.columns)


def merge_counts(rows: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows that created a key and rows that updated one.

    The first row of a key not stored yet creates it; every other row is an update.
    """
    created = (
        rows.select(key).distinct().join(current.select(key), key, "left_anti")
        .agg(F.count("*").alias("created"))
        .scalar()
    )
    return (
        rows.agg(F.count("*").alias("rows"))
        .withColumn("created", created)
        .select("created", (F.col("rows") - F.col("created")).alias("updated"))
    )


def upsert(
    current: DataFrame, changes: DataFrame, key: str, schema: T.StructType, run_at: dict | None = None
) -> DataFrame:
    """Current rows with changed columns replaced by key; other columns keep their values.

    ``changes`` has one row per key. ``run_at`` maps clock columns to the time of the run.
    ``change`` says what happened to each row: created, updated or kept.
    """
    replaced = [name for name in changes.columns if name != key and name in schema.fieldNames()]
    old, new = conform(current, schema).alias("old"), changes.alias("new")
    touched = F.col(f"new.{key}").isNotNull()

    def pick(field: T.StructField) -> Column:
        name = field.name
        if name == key:
            value = F.coalesce(f"new.{key}", f"old.{key}")
        elif run_at and name in run_at:
            value = F.when(touched, run_at[name]).otherwise(F.col(f"old.{name}"))
        elif name in replaced:
            value = F.when(touched, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        else:
            value = F.col(f"old.{name}")
        return value.cast(field.dataType).alias(name)

    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        *[pick(field) for field in schema.fields],
        F.when(~touched, "kept").when(F.col(f"old.{key}").isNull(), "created").otherwise("updated").alias("change"),
    )


def merge_customers(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Customers with the name, business code and currency of their last imported row."""
    changes = last_row_per_key(rows, "customer_id").select(
        "customer_id", "customer_name", "business_code", F.col("currency").alias("default_currency")
    )
    return upsert(current, changes, "customer_id", CUSTOMERS)


def merge_invoices(current: DataFrame, rows: DataFrame, run_at: Column) -> DataFrame:
    """Invoices with the fields of their last imported row."""
    changes = last_row_per_key(rows, "invoice_id").drop("row_number").withColumn(
        "receivables_customer", F.col("customer_id")
    )
    return upsert(current, changes, "invoice_id", INVOICES, {"imported_on": run_at})
