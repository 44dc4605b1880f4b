"""The four report queries. Filters are plain dictionaries; they reach the table scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dashboard

# The fields of each report.
CUSTOMER_FIELDS = [
    "customer_id",
    "customer_name",
    "total_invoices",
    "closed_invoice_count",
    "open_invoice_count",
    "total_invoice_amount",
    "open_amount",
    "average_payment_delay",
    "late_payment_rate",
    "risk_score",
    "risk_level",
    "risk_confidence",
    "risk_explanation",
]
INVOICE_FIELDS = [
    "external_invoice_id",
    "customer_id",
    "customer_name",
    "due_date",
    "days_overdue",
    "invoice_amount",
    "customer_risk_score",
    "customer_risk_level",
    "risk_score",
    "risk_level",
    "suggested_action",
    "explanation",
]
ACTION_FIELDS = [
    "external_invoice_id",
    "customer_id",
    "customer_name",
    "action_type",
    "priority",
    "status",
    "due_date",
    "created_from_risk_score",
    "notes",
]
CHARTS = {
    "Outstanding Amount by Risk Level": ("customers", dashboard.open_amount_by_level),
    "Customer Risk Distribution": ("customers", dashboard.customers_by_level),
    "Aging Bucket Distribution": ("assessments", dashboard.aging),
    "Collection Actions by Status": ("actions", dashboard.actions_by_status),
    "Open Overdue Exposure by Due Month": ("assessments", dashboard.overdue_by_month),
}
DEFAULT_CHART = "Outstanding Amount by Risk Level"


def _number(value) -> float | None:
    """A numeric filter; blank or unreadable input means no filter."""
    try:
        return None if value in (None, "") else float(value)
    except (TypeError, ValueError):
        return None


def _word(value) -> str | None:
    return None if value is None else (str(value).strip() or None)


def _keep(df: DataFrame, equals: Mapping, at_least: Mapping) -> DataFrame:
    for name, value in equals.items():
        if value:
            df = df.filter(F.col(name) == value)
    for name, value in at_least.items():
        if value is not None:
            df = df.filter(F.col(name) >= value)
    return df


def _money_as_double(df: DataFrame) -> DataFrame:
    amounts = {n: F.col(n).cast("double") for n, t in df.dtypes if t.startswith("decimal")}
    return df.withColumns(amounts) if amounts else df


def customer_risk_overview(customers: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """Customers by score, then open amount."""
    f = filters or {}
    kept = _keep(
        customers,
        {"risk_level": f.get("risk_level")},
        {
            "open_amount": _number(f.get("min_open_amount")),
            "late_payment_rate": _number(f.get("min_late_payment_rate")),
            "risk_score": _number(f.get("min_risk_score")),
        },
    )
    return _money_as_double(kept.select(*CUSTOMER_FIELDS)).orderBy(
        F.desc("risk_score"), F.desc("open_amount")
    )


def invoice_collection_priority(assessments: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """Assessments by score, overdue days and amount; Medium and High unless a level is given."""
    f = filters or {}
    level = f.get("risk_level")
    kept = assessments if level else assessments.filter(F.col("risk_level").isin("Medium", "High"))
    kept = _keep(
        kept,
        {
            "risk_level": level,
            "customer_id": _word(f.get("customer_id")),
            "suggested_action": _word(f.get("suggested_action")),
        },
        {"days_overdue": _number(f.get("min_days_overdue"))},
    )
    return _money_as_double(kept.select(*INVOICE_FIELDS)).orderBy(
        F.desc("risk_score"), F.desc("days_overdue"), F.desc("invoice_amount")
    )


def collection_action_queue(actions: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """Actions by due date, then originating score; open ones unless a status is given."""
    f = filters or {}
    kept = _keep(
        actions,
        {
            "status": _word(f.get("status")) or "Open",
            "priority": _word(f.get("priority")),
            "action_type": _word(f.get("action_type")),
            "customer_id": _word(f.get("customer_id")),
        },
        {},
    )
    return kept.select(*ACTION_FIELDS).orderBy("due_date", F.desc("created_from_risk_score"))


def risk_dashboard(
    customers: DataFrame,
    assessments: DataFrame,
    actions: DataFrame,
    filters: Mapping | None = None,
) -> dict[str, DataFrame]:
    """The dashboard's table, one chart series and headline values, each still lazy."""
    f = filters or {}
    tables = {"customers": customers, "assessments": assessments, "actions": actions}
    source, series = CHARTS.get(f.get("chart_metric") or DEFAULT_CHART, CHARTS[DEFAULT_CHART])
    return {
        "table": dashboard.top_customers(customers, f.get("top_customer_limit")),
        "chart": series(tables[source]),
        "summary": dashboard.kpis(customers, assessments, actions),
    }
