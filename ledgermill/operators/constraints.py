"""Constraint checks of the stored tables: every violated rule of a row, in rule order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import messages
from ..functions.risk import LEVELS
from .actions import RESOLVED, active_key

# Allowed statuses.
INVOICE_STATUSES = ("Open", "Closed", "Overdue")
LATE_STATUSES = ("Unknown", "Late", "On Time")

Rules = Sequence[tuple[Column, str]]


def _label(name: str) -> str:
    return name.replace("_", " ").title()


def _negative(name: str) -> tuple[Column, str]:
    return F.col(name) < 0, f"{_label(name)} cannot be negative."


def _score(name: str) -> tuple[Column, str]:
    return ~F.col(name).between(0, 100), f"{_label(name)} must be between 0 and 100."


def _level(name: str) -> tuple[Column, str]:
    bad = (F.col(name) != "") & ~F.col(name).isin(*LEVELS)
    return bad, f"{_label(name)} must be Low, Medium, or High."


def customer_rules() -> Rules:
    def n(name):
        return F.coalesce(F.col(name), F.lit(0))

    too_many = (n("total_invoices") != 0) & (
        n("closed_invoice_count") + n("open_invoice_count") > n("total_invoices")
    )
    return [
        _negative("total_invoices"),
        _negative("closed_invoice_count"),
        _negative("open_invoice_count"),
        _negative("invoice_count"),
        (too_many, "Closed Invoice Count plus Open Invoice Count cannot exceed Total Invoices."),
        _score("risk_score"),
        _level("risk_level"),
        _level("risk_confidence"),
    ]


def invoice_rules() -> Rules:
    def outside(name, allowed):
        return (F.col(name) != "") & ~F.col(name).isin(*allowed)

    return [
        _negative("invoice_amount"),
        _negative("days_overdue"),
        (outside("status", INVOICE_STATUSES), "Status must be Open, Closed, or Overdue."),
        (
            outside("late_payment_status", LATE_STATUSES),
            "Late Payment Status must be Unknown, Late, or On Time.",
        ),
    ]


def assessment_rules() -> Rules:
    return [
        _score("risk_score"),
        _score("customer_risk_score"),
        _level("risk_level"),
        _level("customer_risk_level"),
        _negative("days_overdue"),
        _negative("invoice_amount"),
    ]


def audit_rules() -> Rules:
    return [
        _score("previous_score"),
        _score("new_score"),
        _level("previous_level"),
        _level("new_level"),
    ]


def check_rows(df: DataFrame, rules: Rules) -> DataFrame:
    """The rows with an array of their violations; empty when the row is fine."""
    return df.withColumn("violations", messages(rules))


def violations(df: DataFrame, key: str, rules: Rules) -> DataFrame:
    """One row per violated rule: key, position in the rule order, message."""
    return check_rows(df.withColumn("record", F.col(key)), rules).select(
        "record", F.posexplode("violations").alias("position", "message")
    )


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(rows without a violation, rejected rows with their violations)."""
    return split_checked(check_rows(df, rules))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of rows that ``check_rows`` has judged."""
    fine = F.size("violations") == 0
    return checked.filter(fine).drop("violations"), checked.filter(~fine)


def with_active_key(actions: DataFrame) -> DataFrame:
    """The active key of each action: NULL when resolved, kept when a part is missing."""
    invoice, kind = F.col("external_invoice_id"), F.col("action_type")
    complete = (invoice != "") & (kind != "")
    key = (
        F.when(F.col("status") == RESOLVED, F.lit(None).cast("string"))
        .when(complete, active_key(invoice, kind))
        .otherwise(F.col("active_invoice_key"))
    )
    return actions.withColumn("active_invoice_key", key)


def repeated_active_actions(actions: DataFrame) -> DataFrame:
    """Invoice and action type pairs with more than one unresolved action."""
    invoice, kind = F.col("external_invoice_id"), F.col("action_type")
    unresolved = F.coalesce(F.col("status"), F.lit("")) != RESOLVED
    return (
        actions.filter(unresolved & (invoice != "") & (kind != ""))
        .groupBy("external_invoice_id", "action_type")
        .agg(F.count("*").alias("active_actions"))
        .filter(F.col("active_actions") > 1)
    )
