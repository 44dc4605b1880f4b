"""Collection actions: derived from assessments, kept unique while unresolved, auto-resolved."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank

from ..functions.conditions import first_match, is_filled
from ..functions.risk import ESCALATE, FOLLOW_UP, REMIND
from ..functions.text import fill

# The rule for actions, apart from the scoring settings, and its notes.
ESCALATE_AFTER_DAYS = 30
REMINDER_DAYS = 3
RESOLVED = "Resolved"
ESCALATE_NOTE = (
    "High-risk invoice {invoice} is {days} days overdue. Escalate collection immediately."
)
FOLLOW_UP_NOTE = "High-risk invoice {invoice} requires immediate follow-up."
REMIND_NOTE = "Medium-risk invoice {invoice}. Send payment reminder."
CLOSED_NOTE = (
    "Auto-resolved because linked Invoice Risk Assessment {assessment} for invoice {invoice} "
    "is closed."
)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def active_key(invoice: Column, action_type: Column) -> Column:
    return F.concat(_text(invoice), F.lit(":"), action_type)


def action_candidates(assessments: DataFrame, analysis_date: Column | date | str) -> DataFrame:
    """Open Medium and High assessments with the action each calls for."""
    on = analysis_date if isinstance(analysis_date, Column) else F.lit(analysis_date).cast("date")
    days = F.coalesce(F.col("days_overdue"), F.lit(0))
    high, medium = F.col("risk_level") == "High", F.col("risk_level") == "Medium"
    late = days > ESCALATE_AFTER_DAYS
    names = {"invoice": _text(F.col("external_invoice_id")), "days": days.cast("string")}
    return (
        assessments.filter((F.col("is_open") == 1) & F.col("risk_level").isin("Medium", "High"))
        .withColumns(
            {
                "action_type": first_match([(high & late, ESCALATE), (high, FOLLOW_UP), (medium, REMIND)]),
                "priority": first_match([(high, "High"), (medium, "Medium")]),
                "action_due_date": F.when(high, on).otherwise(F.date_add(on, REMINDER_DAYS)),
                "notes": first_match(
                    [
                        (high & late, fill(ESCALATE_NOTE, names)),
                        (high, fill(FOLLOW_UP_NOTE, names)),
                        (medium, fill(REMIND_NOTE, names)),
                    ]
                ),
            }
        )
    )


def _unresolved_keys(actions: DataFrame) -> DataFrame:
    """The distinct (invoice, action type) pairs that block a new action."""
    return (
        actions.filter(
            (F.coalesce(F.col("status"), F.lit("")) != RESOLVED)
            & is_filled(F.col("external_invoice_id"))
            & is_filled(F.col("action_type"))
        )
        .select("external_invoice_id", "action_type")
        .distinct()
    )


def new_actions(
    assessments: DataFrame,
    actions: DataFrame,
    analysis_date: Column | date | str,
    run_at: Column | None = None,
) -> DataFrame:
    """Actions to add: candidates without an unresolved action of the same invoice and type.

    Run it on actions that were already resolved for closed invoices. Ids hash the
    assessment, the type and the run time, so a later action on the same pair gets its own.
    """
    stamp = run_at if run_at is not None else F.lit(None).cast("timestamp")
    fresh = action_candidates(assessments, analysis_date).join(
        _unresolved_keys(actions), ["external_invoice_id", "action_type"], "left_anti"
    )
    return fresh.select(
        F.sha2(
            F.concat_ws("|", "assessment_id", "action_type", F.coalesce(stamp.cast("string"), F.lit(""))), 256
        ).alias("action_id"),
        "receivables_customer",
        "receivables_invoice",
        F.col("assessment_id").alias("invoice_risk_assessment"),
        "external_invoice_id",
        "customer_id",
        "customer_name",
        "action_type",
        "priority",
        F.lit("Open").alias("status"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.col("action_due_date").alias("due_date"),
        "notes",
        F.lit(1).alias("auto_generated"),
        active_key(F.col("external_invoice_id"), F.col("action_type")).alias("active_invoice_key"),
        F.coalesce("risk_score", F.lit(0)).alias("created_from_risk_score"),
        stamp.alias("last_updated_on"),
    )


def skipped_actions(
    assessments: DataFrame, actions: DataFrame, analysis_date: Column | date | str
) -> DataFrame:
    """Candidates left out because an unresolved action for the pair exists."""
    return action_candidates(assessments, analysis_date).join(
        _unresolved_keys(actions), ["external_invoice_id", "action_type"], "left_semi"
    )


def resolve_closed(
    actions: DataFrame, assessments: DataFrame, run_at: Column | None = None
) -> DataFrame:
    """Resolve unresolved actions of closed assessments and append a note.

    Adds ``resolved_now``.
    """
    closed = assessments.filter(F.coalesce(F.col("is_open"), F.lit(0)) == 0).select(
        F.col("assessment_id").alias("closed_assessment"),
        F.col("external_invoice_id").alias("closed_invoice"),
    )
    marked = actions.join(
        closed, F.col("invoice_risk_assessment") == F.col("closed_assessment"), "left"
    ).withColumn(
        "resolved_now", F.col("closed_assessment").isNotNull() & F.coalesce(F.col("status") != RESOLVED, F.lit(False))
    )
    now = F.col("resolved_now")
    note = fill(
        CLOSED_NOTE,
        {"assessment": F.col("closed_assessment"), "invoice": _text(F.col("closed_invoice"))},
    )
    changes = {
        "status": F.when(now, F.lit(RESOLVED)).otherwise(F.col("status")),
        "active_invoice_key": F.when(~now, F.col("active_invoice_key")),
        "notes": F.when(
            now, F.concat_ws("\n\n", F.nullif(F.col("notes"), F.lit("")), note)
        ).otherwise(F.col("notes")),
    }
    if run_at is not None:
        changes["last_updated_on"] = F.when(now, run_at).otherwise(F.col("last_updated_on"))
    return marked.withColumns(changes).drop("closed_assessment", "closed_invoice")


# Fixed: actions are generated by risk score, then days overdue, both descending, then by
# assessment; missing numbers come last, a missing id first.
def generation_order() -> list[Column]:
    return [F.col("risk_score").desc_nulls_last(), F.col("days_overdue").desc_nulls_last(), F.col("assessment_id").asc_nulls_first()]


def generation_ranked(candidates: DataFrame) -> DataFrame:
    """Action candidates with ``generation_rank``, their place (from 1) in generation order."""
    return global_rank(candidates, generation_order(), "generation_rank")
