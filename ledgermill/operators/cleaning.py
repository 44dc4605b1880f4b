"""Cleaning of raw invoice exports: typed columns, rejection reasons, views and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import first_match
from ..functions.dates import compact_digits, rolling_compact_date, rolling_iso_date
from ..functions.numbers import leading_real, rounded, whole_text
from ..functions.text import blank_to_null
from .common import settle, unpivot_metrics

# Rejection reasons, in the order they are tested.
MISSING_ID = "Missing invoice ID"
MISSING_CUSTOMER = "Missing customer"
BAD_POSTING_DATE = "Invalid posting date"
BAD_DUE_DATE = "Invalid due date"
BAD_AMOUNT = "Invalid invoice amount"
BAD_OPEN_FLAG = "Invalid open status"
CLOSED_NOT_CLEARED = "Closed invoice missing clear date"
OPEN_BUT_CLEARED = "Open invoice has clear date"
CLEARED_TOO_EARLY = "Clear date before posting date"

# Which fields hold timestamp-like dates, YYYYMMDD dates, whole numbers and numeric ids.
ISO_DATES = ("clear_date", "posting_date")
COMPACT_DATES = (
    "document_create_date",
    "document_create_date_1",
    "due_date",
    "baseline_create_date",
)
WHOLE_NUMBERS = ("business_year", "posting_id", "is_open")
NUMBER_IDS = ("doc_id", "invoice_id")

TRAINING_COLUMNS = [
    "customer_id",
    "customer_name",
    "invoice_id",
    "posting_date",
    "due_date",
    "invoice_amount",
    "currency",
    "payment_terms",
    "is_open",
    "payment_delay_days",
    "is_late",
]

QUALITY_METRICS = [
    "raw_rows",
    "normalized_rows",
    "clean_rows",
    "rejected_rows",
    "labeled_paid_rows",
    "open_invoice_rows",
]


def normalize(raw: DataFrame) -> DataFrame:
    """Raw text rows as typed rows without exact duplicates.

    Texts are trimmed in a first step, so each later expression reads a finished column.
    """
    trimmed = raw.select(
        blank_to_null("business_code").alias("business_code"),
        blank_to_null("customer_id_raw").alias("customer_id"),
        blank_to_null("customer_name_raw").alias("customer_name"),
        F.substring(blank_to_null("clear_date_raw"), 1, 10).alias("clear_date"),
        blank_to_null("business_year_raw").alias("business_year"),
        blank_to_null("doc_id_raw").alias("doc_id"),
        F.substring(blank_to_null("posting_date_raw"), 1, 10).alias("posting_date"),
        compact_digits(blank_to_null("document_create_date_raw")).alias("document_create_date"),
        compact_digits(blank_to_null("document_create_date_1_raw")).alias("document_create_date_1"),
        compact_digits(blank_to_null("due_date_raw")).alias("due_date"),
        blank_to_null("invoice_currency_raw").alias("currency"),
        blank_to_null("document_type_raw").alias("document_type"),
        blank_to_null("posting_id_raw").alias("posting_id"),
        blank_to_null("invoice_amount_raw").alias("invoice_amount"),
        compact_digits(blank_to_null("baseline_create_date_raw")).alias("baseline_create_date"),
        blank_to_null("payment_terms_raw").alias("payment_terms"),
        blank_to_null("invoice_id_raw").alias("invoice_id"),
        blank_to_null("is_open_raw").alias("is_open"),
    )
    typed = {
        **{name: rolling_iso_date(F.col(name)) for name in ISO_DATES},
        **{name: rolling_compact_date(F.col(name)) for name in COMPACT_DATES},
        **{name: leading_real(name).try_cast("int") for name in WHOLE_NUMBERS},
        **{name: whole_text(leading_real(name)) for name in NUMBER_IDS},
        "invoice_amount": leading_real("invoice_amount"),
    }
    parsed = trimmed.select(
        *[typed.get(name, F.col(name)).alias(name) for name in trimmed.columns]
    )
    return settle(parsed, *parsed.columns).distinct()


def review(normalized: DataFrame) -> DataFrame:
    """Add the first rejection reason; NULL means accepted (a NULL open flag passes)."""
    c = F.col
    reason = first_match(
        [
            (c("invoice_id").isNull() | (c("invoice_id") == "0"), MISSING_ID),
            (c("customer_id").isNull(), MISSING_CUSTOMER),
            (c("posting_date").isNull(), BAD_POSTING_DATE),
            (c("due_date").isNull(), BAD_DUE_DATE),
            (c("invoice_amount").isNull() | (c("invoice_amount") <= 0), BAD_AMOUNT),
            (~c("is_open").isin(0, 1), BAD_OPEN_FLAG),
            ((c("is_open") == 0) & c("clear_date").isNull(), CLOSED_NOT_CLEARED),
            ((c("is_open") == 1) & c("clear_date").isNotNull(), OPEN_BUT_CLEARED),
            (c("clear_date") < c("posting_date"), CLEARED_TOO_EARLY),
        ]
    )
    return normalized.withColumn("rejection_reason", reason)


def accept(reviewed: DataFrame) -> DataFrame:
    """Accepted rows with the payment delay and late flag."""
    cleared = F.col("clear_date").isNotNull()
    return reviewed.filter(F.col("rejection_reason").isNull()).select(
        *[name for name in reviewed.columns if name != "rejection_reason"],
        F.datediff("clear_date", "due_date").alias("payment_delay_days"),
        F.when(cleared, (F.col("clear_date") > F.col("due_date")).cast("int")).alias("is_late"),
    )


def clean(raw: DataFrame) -> DataFrame:
    return accept(review(normalize(raw)))


def repeated_ids(cleaned: DataFrame) -> DataFrame:
    """Invoice ids carried by more than one distinct clean row."""
    return (
        cleaned.groupBy("invoice_id")
        .agg(F.count("*").alias("row_count"))
        .filter(F.col("row_count") > 1)
    )


def require_unique_ids(cleaned: DataFrame) -> None:
    """Stop the job when an invoice id repeats, before anything is published."""
    repeats = repeated_ids(cleaned).limit(5).collect()
    if repeats:
        shown = ", ".join(row["invoice_id"] for row in repeats)
        raise ValueError(f"invoice_id is not unique in the cleaned data: {shown}")


def labeled(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter((F.col("is_open") == 0) & F.col("clear_date").isNotNull())


def still_open(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter((F.col("is_open") == 1) & F.col("clear_date").isNull())


def training_view(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*TRAINING_COLUMNS)


def register_views(cleaned: DataFrame) -> None:
    """Temp views over the cleaned invoices for SQL users."""
    cleaned.createOrReplaceTempView("invoice_clean")
    labeled(cleaned).createOrReplaceTempView("labeled_invoices")
    still_open(cleaned).createOrReplaceTempView("open_invoices")
    training_view(cleaned).createOrReplaceTempView("invoice_risk_training_view")


def row_counts(raw: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The six row counts as (metric, value): one pass over raw, one over reviewed rows."""
    accepted = F.col("rejection_reason").isNull()
    cleared = F.col("clear_date").isNotNull()
    from_raw = raw.agg(F.count("*").alias("raw_rows"))
    from_reviewed = reviewed.agg(
        F.count("*").alias("normalized_rows"),
        F.count_if(accepted).alias("clean_rows"),
        F.count_if(~accepted).alias("rejected_rows"),
        F.count_if(accepted & (F.col("is_open") == 0) & cleared).alias("labeled_paid_rows"),
        F.count_if(accepted & (F.col("is_open") == 1) & ~cleared).alias("open_invoice_rows"),
    )
    return unpivot_metrics(from_raw, QUALITY_METRICS[:1]).unionByName(
        unpivot_metrics(from_reviewed, QUALITY_METRICS[1:])
    )


def reason_counts(reviewed: DataFrame) -> DataFrame:
    return (
        reviewed.groupBy(F.coalesce("rejection_reason", F.lit("Accepted")).alias("status"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "status")
    )


def currency_totals(cleaned: DataFrame) -> DataFrame:
    """Invoices and amount per currency; summed as decimals so row order cannot matter."""
    amount = F.sum(F.col("invoice_amount").cast("decimal(28,6)"))
    return (
        cleaned.groupBy("currency")
        .agg(
            F.count("*").alias("invoices"),
            F.round(amount, 2).cast("double").alias("total_invoice_amount"),
        )
        .orderBy(F.desc("invoices"), "currency")
    )


def labeled_summary(cleaned: DataFrame) -> DataFrame:
    return labeled(cleaned).agg(
        F.min("posting_date").alias("earliest_posting_date"),
        F.max("posting_date").alias("latest_posting_date"),
        rounded(F.avg("payment_delay_days"), 2).alias("avg_payment_delay_days"),
        rounded(100.0 * F.avg("is_late"), 2).alias("late_payment_rate_percent"),
    )


def ordered_for_export(cleaned: DataFrame) -> DataFrame:
    return cleaned.orderBy("posting_date", "invoice_id")
