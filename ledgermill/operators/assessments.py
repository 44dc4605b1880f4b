"""Invoice risk assessments: scoring open invoices, merging and closing."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_past
from ..functions.risk import average_amount
from ..functions.text import fill
from ..schemas import ASSESSMENTS, MONEY
from .scoring import score_invoices

# What a closed assessment says.
CLOSED_ACTION = "No action - invoice closed"
CLOSED_EXPLANATION = (
    "Linked Receivables Invoice {invoice} is closed. No collection action is required."
)


def latest_posting_date(invoices: DataFrame) -> Column:
    """The latest posting date as a scalar subquery; the plan computes it once."""
    return invoices.select(F.max("posting_date").alias("analysis_date")).scalar()


def analysis_date_of(invoices: DataFrame) -> date:
    """The latest posting date as a value; an error when no invoice has one."""
    found = invoices.agg(F.max("posting_date")).first()[0]
    if found is None:
        raise ValueError("no invoice has a posting date to use as the analysis date")
    return found


def _as_date(value: Column | date | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def open_invoice_metrics(
    invoices: DataFrame, customers: DataFrame, analysis_date: Column | date | str
) -> DataFrame:
    """Open invoices with overdue days and their customer's average and level.

    The join is left to adaptive execution: a small customer table is broadcast by its
    measured size, otherwise a dominant customer's partition is split.
    """
    looked_up = customers.select(
        "customer_id",
        F.col("customer_id").alias("receivables_customer"),
        F.col("customer_name").alias("customer_name"),
        average_amount(F.col("total_invoice_amount"), F.col("total_invoices")).alias(
            "average_invoice_amount"
        ),
        F.coalesce("risk_score", F.lit(0)).alias("customer_risk_score"),
        F.coalesce(F.nullif(F.col("risk_level"), F.lit("")), F.lit("Low")).alias(
            "customer_risk_level"
        ),
    )
    return (
        invoices.filter(F.col("is_open") == 1)
        .select(
            "invoice_id", "customer_id", "posting_date", "due_date", "currency",
            "invoice_amount", "is_open",
        )
        .join(looked_up, "customer_id", "inner")
        .withColumn("days_overdue", days_past(F.col("due_date"), _as_date(analysis_date)))
    )


def invoices_without_customer(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """Open invoices whose customer is missing: the row errors of the assessment step."""
    return (
        invoices.filter(F.col("is_open") == 1)
        .select("invoice_id", "customer_id")
        .join(customers.select("customer_id"), "customer_id", "left_anti")
    )


def assess_open_invoices(
    invoices: DataFrame,
    customers: DataFrame,
    analysis_date: Column | date | str,
    settings: Mapping | None = None,
) -> DataFrame:
    """Fresh assessment fields for every open invoice that has a customer."""
    scored = score_invoices(open_invoice_metrics(invoices, customers, analysis_date), settings)
    return scored.select(
        F.col("invoice_id").alias("receivables_invoice"),
        F.col("invoice_id").alias("external_invoice_id"),
        "invoice_id",
        "receivables_customer",
        "customer_id",
        "customer_name",
        "posting_date",
        "due_date",
        "currency",
        F.col("invoice_amount").cast(MONEY).alias("invoice_amount"),
        "is_open",
        "days_overdue",
        "customer_risk_score",
        "customer_risk_level",
        "risk_score",
        "risk_level",
        "suggested_action",
        "explanation",
    )


def merge_assessments(current: DataFrame, fresh: DataFrame, run_at: Column) -> DataFrame:
    """Current assessments with fresh ones merged in, keeping the prior score and level.

    A fresh row takes over the assessment of the same external invoice id, else the one of
    the same invoice, else it is new. ``merge_status`` is created, updated or kept.
    """
    by_external = current.filter(F.col("external_invoice_id").isNotNull()).select(
        F.col("external_invoice_id"), F.col("assessment_id").alias("by_external")
    )
    by_invoice = current.filter(F.col("receivables_invoice").isNotNull()).select(
        F.col("receivables_invoice"), F.col("assessment_id").alias("by_invoice")
    )
    keyed = (
        fresh.join(by_external, "external_invoice_id", "left")
        .join(by_invoice, "receivables_invoice", "left")
        .withColumn(
            "assessment_id",
            F.coalesce("by_external", "by_invoice", F.sha2(F.col("external_invoice_id"), 256)),
        )
        .drop("by_external", "by_invoice")
    )
    old, new = current.alias("old"), keyed.alias("new")
    is_new = F.col("new.assessment_id").isNotNull()
    was_there = F.col("old.assessment_id").isNotNull()

    def pick(name: str) -> Column:
        if name == "last_calculated_on":
            return F.when(is_new, run_at).otherwise(F.col(f"old.{name}")).alias(name)
        return F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return old.join(new, F.col("old.assessment_id") == F.col("new.assessment_id"), "full_outer").select(
        *[pick(name) for name in ASSESSMENTS.fieldNames()],
        F.col("old.risk_score").alias("previous_risk_score"),
        F.col("old.risk_level").alias("previous_risk_level"),
        F.when(~is_new, F.lit("kept")).when(was_there, F.lit("updated")).otherwise(
            F.lit("created")
        ).alias("merge_status"),
    )


def close_stale_assessments(
    assessments: DataFrame, invoices: DataFrame, run_at: Column | None = None
) -> DataFrame:
    """Reset assessments that are not closed although their invoice is.

    Adds ``closed_now``; assessments without a matching invoice stay as they are.
    """
    closed = invoices.filter(F.coalesce(F.col("is_open"), F.lit(0)) == 0).select(
        F.col("invoice_id").alias("closed_invoice")
    )
    hit = F.col("closed_invoice").isNotNull() & (F.coalesce(F.col("is_open"), F.lit(0)) != 0)
    marked = assessments.join(
        closed, F.col("receivables_invoice") == F.col("closed_invoice"), "left"
    ).withColumn("closed_now", hit)
    now = F.col("closed_now")
    changes = {
        "is_open": F.when(now, F.lit(0)).otherwise(F.col("is_open")),
        "risk_score": F.when(now, F.lit(0)).otherwise(F.col("risk_score")),
        "risk_level": F.when(now, F.lit("Low")).otherwise(F.col("risk_level")),
        "suggested_action": F.when(now, F.lit(CLOSED_ACTION)).otherwise(F.col("suggested_action")),
        "explanation": F.when(
            now, fill(CLOSED_EXPLANATION, {"invoice": F.col("closed_invoice")})
        ).otherwise(F.col("explanation")),
    }
    if run_at is not None:
        changes["last_calculated_on"] = F.when(now, run_at).otherwise(F.col("last_calculated_on"))
    return marked.withColumns(changes).drop("closed_invoice")
