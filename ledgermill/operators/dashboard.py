"""Dashboard metrics over customers, assessments and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import first_match
from ..functions.risk import LEVELS
from .actions import RESOLVED
from .common import literal_rows

# Aging buckets in display order, and the value for a missing level or status.
AGING_BUCKETS = ("Current", "1-30", "31-60", "61-90", "90+")
UNCLASSIFIED = "Unclassified"
DEFAULT_TOP = 10
MAX_TOP = 50


def aging_bucket(days: Column) -> Column:
    """The aging bucket of an overdue day count; missing counts as current."""
    days = F.coalesce(days, F.lit(0))
    return first_match(
        [
            (days <= 0, AGING_BUCKETS[0]),
            (days <= 30, AGING_BUCKETS[1]),
            (days <= 60, AGING_BUCKETS[2]),
            (days <= 90, AGING_BUCKETS[3]),
        ],
        AGING_BUCKETS[4],
    )


def named_or_unclassified(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNCLASSIFIED))


def fill_levels(grouped: DataFrame, key: str, listed: tuple[str, ...], values: list[str]) -> DataFrame:
    """Listed keys in order with 0 where a group is absent; other keys follow at the end."""
    rows = [(name, position) for position, name in enumerate(listed)]
    order = literal_rows(grouped.sparkSession, [key, "position"], rows)
    filled = order.join(grouped, key, "full_outer").select(
        key,
        "position",
        *[F.coalesce(F.col(v), F.lit(0)).cast(grouped.schema[v].dataType).alias(v) for v in values],
    )
    return filled.orderBy(F.asc_nulls_last("position"), key).drop("position")


def customers_by_level(customers: DataFrame) -> DataFrame:
    grouped = customers.groupBy(named_or_unclassified("risk_level").alias("risk_level")).agg(
        F.count("*").alias("customer_count")
    )
    return fill_levels(grouped, "risk_level", LEVELS, ["customer_count"])


def open_amount_by_level(customers: DataFrame) -> DataFrame:
    grouped = customers.groupBy(named_or_unclassified("risk_level").alias("risk_level")).agg(
        F.coalesce(F.sum("open_amount").cast("double"), F.lit(0.0)).alias("open_amount")
    )
    return fill_levels(grouped, "risk_level", LEVELS, ["open_amount"])


def aging(assessments: DataFrame) -> DataFrame:
    """Open assessments per aging bucket; every bucket is listed."""
    grouped = (
        assessments.filter(F.col("is_open") == 1)
        .groupBy(aging_bucket(F.col("days_overdue")).alias("aging_bucket"))
        .agg(
            F.count("*").alias("invoice_count"),
            F.coalesce(F.sum("invoice_amount").cast("double"), F.lit(0.0)).alias("invoice_amount"),
        )
    )
    return fill_levels(grouped, "aging_bucket", AGING_BUCKETS, ["invoice_count", "invoice_amount"])


def actions_by_status(actions: DataFrame) -> DataFrame:
    return (
        actions.groupBy(named_or_unclassified("status").alias("status"))
        .agg(F.count("*").alias("action_count"))
        .orderBy(F.desc("action_count"), "status")
    )


def overdue_by_month(assessments: DataFrame) -> DataFrame:
    """Open overdue exposure per due month, oldest first."""
    overdue = (
        (F.col("is_open") == 1)
        & (F.coalesce(F.col("days_overdue"), F.lit(0)) > 0)
        & F.col("due_date").isNotNull()
    )
    return (
        assessments.filter(overdue)
        .groupBy(F.date_format("due_date", "yyyy-MM").alias("due_month"))
        .agg(
            F.count("*").alias("invoice_count"),
            F.coalesce(F.sum("invoice_amount").cast("double"), F.lit(0.0)).alias("invoice_amount"),
        )
        .orderBy("due_month")
    )


def top_limit(limit) -> int:
    """A row limit between 1 and 50; missing or unreadable values give 10."""
    try:
        wanted = int(limit or 0)
    except (TypeError, ValueError):
        wanted = 0
    return max(1, min(wanted or DEFAULT_TOP, MAX_TOP))


def top_customers(customers: DataFrame, limit=DEFAULT_TOP) -> DataFrame:
    """The riskiest customers, larger open amount first among equal scores."""
    return (
        customers.select(
            "customer_id",
            "customer_name",
            "risk_level",
            "risk_score",
            "risk_confidence",
            F.col("open_amount").cast("double").alias("open_amount"),
            "open_invoice_count",
            "late_payment_rate",
            "average_payment_delay",
        )
        .orderBy(F.desc("risk_score"), F.desc("open_amount"), "customer_id")
        .limit(top_limit(limit))
    )


def kpis(customers: DataFrame, assessments: DataFrame, actions: DataFrame) -> DataFrame:
    """The seven headline values in one row, from one aggregate per table."""
    high = F.col("risk_level") == "High"
    from_customers = customers.agg(
        F.count("*").alias("total_customers"),
        F.count_if(high).alias("high_risk_customers"),
        F.coalesce(F.sum("open_amount").cast("double"), F.lit(0.0)).alias("total_open_amount"),
        F.coalesce(F.sum(F.when(high, F.col("open_amount"))).cast("double"), F.lit(0.0)).alias(
            "high_risk_open_amount"
        ),
    )
    exposed = (F.col("is_open") == 1) & F.col("risk_level").isin("Medium", "High")
    from_assessments = assessments.agg(F.count_if(exposed).alias("n"))
    unresolved = F.col("status") != RESOLVED
    from_actions = actions.agg(
        F.struct(
            F.count_if(unresolved).alias("open"),
            F.count_if(unresolved & (F.col("priority") == "High")).alias("high"),
        ).alias("n")
    )
    return from_customers.select(
        "*",
        from_assessments.scalar().alias("medium_high_open_invoices"),
        from_actions.scalar().alias("actions"),
    ).select(
        *from_customers.columns,
        "medium_high_open_invoices",
        F.col("actions.open").alias("open_collection_actions"),
        F.col("actions.high").alias("high_priority_open_actions"),
    )
