"""Audit rows for changed scores and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the audited tables are named in the log.
CUSTOMER_DOC = "Receivables Customer"
ASSESSMENT_DOC = "Invoice Risk Assessment"


def audit_rows(
    scored: DataFrame,
    *,
    document: str,
    entity: str,
    source: str,
    name: str,
    reason: str,
    run_at: Column | None = None,
) -> DataFrame:
    """One row per record whose score or level differs from ``previous_risk_*``.

    A missing previous score counts as 0, a missing previous level as '', and a missing
    new level as Low.
    """
    external = "external_invoice_id" if "external_invoice_id" in scored.columns else None
    changes = scored.select(
        F.lit(document).alias("reference_doctype"),
        F.col(name).alias("reference_name"),
        F.lit(entity).alias("entity_type"),
        "customer_id",
        (F.col(external) if external else F.lit(None).cast("string")).alias("external_invoice_id"),
        F.coalesce("previous_risk_score", F.lit(0)).alias("previous_score"),
        F.coalesce("risk_score", F.lit(0)).alias("new_score"),
        F.coalesce("previous_risk_level", F.lit("")).alias("previous_level"),
        F.coalesce(F.nullif(F.col("risk_level"), F.lit("")), F.lit("Low")).alias("new_level"),
        F.col(reason).alias("reason"),
        F.lit(source).alias("source"),
        (run_at if run_at is not None else F.lit(None).cast("timestamp")).alias("calculated_on"),
    )
    return changes.filter(
        (F.col("previous_score") != F.col("new_score"))
        | (F.col("previous_level") != F.col("new_level"))
    )


def customer_audit(scored: DataFrame, run_at: Column | None = None) -> DataFrame:
    return audit_rows(
        scored,
        document=CUSTOMER_DOC,
        entity="Customer",
        source="Customer Risk",
        name="customer_id",
        reason="risk_explanation",
        run_at=run_at,
    )


def assessment_audit(scored: DataFrame, run_at: Column | None = None) -> DataFrame:
    return audit_rows(
        scored,
        document=ASSESSMENT_DOC,
        entity="Invoice",
        source="Invoice Risk",
        name="assessment_id",
        reason="explanation",
        run_at=run_at,
    )
