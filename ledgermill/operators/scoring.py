"""Rule scoring of customers and invoices.

Score, level and text are added in stages, so each is computed once and then referenced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk


def score_customers(customers: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """Add risk_score, risk_level, risk_confidence and risk_explanation."""
    merged = risk.scoring_settings(settings)
    average = risk.average_amount(F.col("total_invoice_amount"), F.col("total_invoices"))
    rules = risk.customer_rules(merged, F.col("__average"))
    return (
        customers.withColumn("__average", average)
        .withColumn("risk_score", risk.customer_score(rules))
        .withColumn("risk_level", risk.level_for(F.col("risk_score"), merged))
        .withColumns(
            {
                "risk_confidence": risk.confidence_for(F.col("closed_invoice_count")),
                "risk_explanation": risk.customer_explanation(rules, F.col("risk_level")),
            }
        )
        .drop("__average")
    )


def score_invoices(invoices: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """Add risk_score, risk_level, suggested_action and explanation."""
    merged = risk.scoring_settings(settings)
    rules = risk.invoice_rules(merged)
    return (
        invoices.withColumn("risk_score", risk.invoice_score(rules))
        .withColumn("risk_level", risk.level_for(F.col("risk_score"), merged))
        .withColumn(
            "suggested_action",
            risk.action_for(F.col("risk_level"), F.col("days_overdue"), merged),
        )
        .withColumn(
            "explanation",
            risk.invoice_explanation(rules, F.col("risk_level"), F.col("suggested_action")),
        )
    )
