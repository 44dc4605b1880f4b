"""Feature, target and leakage columns, and the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TARGET = "slow_payer_label"
GROUP = "company_number"
NUMERIC_FEATURES = [
    "pct_paid_within_30",
    "pct_paid_31_60",
    "pct_paid_later_60",
    "pct_not_paid_within_terms",
    "pct_not_paid_due_to_dispute",
    "shortest_standard_payment_period",
    "longest_standard_payment_period",
    "maximum_contractual_payment_period",
    "company_reporting_count",
    "payment_terms_changed_covid_related",
    "payment_terms_changed_policy_related",
    "payment_terms_changed_supplier_related",
]
CATEGORICAL_FEATURES = [
    "payment_terms_changed_flag",
    "e_invoicing_offered",
    "supply_chain_financing_offered",
    "participates_in_payment_codes",
]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
LEAKAGE_COLUMNS = {
    "avg_days_to_pay",
    "slow_payer_label",
    "late_terms_label",
    "payment_speed_score",
    "payment_behavior_score",
    "public_payment_risk_band",
}


def check_features(features: Sequence[str] = FEATURES) -> None:
    """Refuse features that reveal the target."""
    leaking = sorted(LEAKAGE_COLUMNS.intersection(features))
    if leaking:
        raise ValueError(f"Feature list contains leakage columns: {', '.join(leaking)}")


def typed_features(df: DataFrame) -> list[Column]:
    """Every feature with its type: numbers from any readable text, a missing one as NULL."""
    have = set(df.columns)

    def typed(name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("double" if name in NUMERIC_FEATURES else "string").alias(name)
        if name in NUMERIC_FEATURES:
            return F.col(name).try_cast("double").alias(name)
        return F.col(name).cast("string").alias(name)

    return [typed(name) for name in FEATURES]


def training_rows(df: DataFrame) -> DataFrame:
    """Group, integer target and typed features of the rows that have a group and a target."""
    check_features()
    missing = [c for c in (GROUP, TARGET, *FEATURES) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required training columns: {', '.join(missing)}")
    return df.select(
        F.col(GROUP).cast("string").alias(GROUP),
        F.col(TARGET).try_cast("double").cast("int").alias(TARGET),
        *typed_features(df),
    ).na.drop(subset=[GROUP, TARGET])
