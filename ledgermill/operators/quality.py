"""Data quality counts over stored invoices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpivot_metrics


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or blank where the field is text."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "string":
        return c.isNull() | (F.trim(c) == "")
    return c.isNull()


def count_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row with the number of rows meeting each named condition, in a single pass."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in conditions.items()])


def invoice_scorecard(invoices: DataFrame) -> DataFrame:
    """Twelve invoice quality counts as (metric, value) rows."""
    c = F.col
    flag = c("is_open")
    counts = {
        "missing_customer_id": is_missing(invoices, "customer_id"),
        "missing_external_invoice_id": is_missing(invoices, "invoice_id"),
        "missing_due_date": is_missing(invoices, "due_date"),
        "missing_invoice_amount": is_missing(invoices, "invoice_amount"),
        "open_invoices": flag == 1,
        "closed_invoices": flag == 0,
        "invalid_open_flags": flag.isNull() | ~flag.isin(0, 1),
        "invoices_with_negative_amount": c("invoice_amount") < 0,
        "invoices_with_clear_date_but_open": (flag == 1) & c("clear_date").isNotNull(),
        "invoices_closed_without_clear_date": (flag == 0) & c("clear_date").isNull(),
    }
    rows = count_where(invoices, {"total_invoices": F.lit(True), **counts})
    # The distinct count gets its own aggregate: sharing one would expand every row.
    customers = (
        invoices.filter(c("customer_id").isNotNull() & (c("customer_id") != ""))
        .select("customer_id")
        .distinct()
        .agg(F.count("*").alias("unique_customers"))
    )
    return unpivot_metrics(rows, ["total_invoices", *counts]).unionByName(
        unpivot_metrics(customers, ["unique_customers"])
    )
