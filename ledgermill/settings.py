"""The seven business settings and how they set the detailed rule weights."""

from __future__ import annotations

from collections.abc import Mapping

from .functions.risk import number_setting, scoring_settings

# Stock business settings.
STOCK_SETTINGS = {
    "high_risk_threshold": 70,
    "medium_risk_threshold": 40,
    "overdue_weight": 30,
    "late_payment_weight": 20,
    "high_outstanding_weight": 20,
    "multiple_unpaid_weight": 10,
    "unusually_large_invoice_weight": 10,
}
# Which detailed weight each business setting falls back to.
FALLBACK = {
    "medium_risk_threshold": "medium_risk_threshold",
    "high_risk_threshold": "high_risk_threshold",
    "late_payment_weight": "customer_late_payment_medium_weight",
    "overdue_weight": "invoice_overdue_medium_weight",
    "high_outstanding_weight": "customer_open_amount_high_weight",
    "multiple_unpaid_weight": "customer_open_invoice_medium_weight",
    "unusually_large_invoice_weight": "invoice_amount_low_weight",
}
# Detailed weight = business setting x factor + extra; halves round to even.
DERIVED = {
    "customer_late_payment_medium_weight": ("late_payment_weight", 1, 0),
    "customer_late_payment_high_weight": ("late_payment_weight", 1, 10),
    "invoice_overdue_any_weight": ("overdue_weight", 0.25, 0),
    "invoice_overdue_low_weight": ("overdue_weight", 0.5, 0),
    "invoice_overdue_medium_weight": ("overdue_weight", 1, 0),
    "invoice_overdue_high_weight": ("overdue_weight", 1, 10),
    "customer_open_amount_low_weight": ("high_outstanding_weight", 0.5, 0),
    "customer_open_amount_medium_weight": ("high_outstanding_weight", 0.75, 0),
    "customer_open_amount_high_weight": ("high_outstanding_weight", 1, 0),
    "customer_open_invoice_low_weight": ("multiple_unpaid_weight", 0.5, 0),
    "customer_open_invoice_medium_weight": ("multiple_unpaid_weight", 1, 0),
    "customer_open_invoice_high_weight": ("multiple_unpaid_weight", 1, 5),
    "invoice_amount_low_weight": ("unusually_large_invoice_weight", 1, 0),
    "invoice_amount_medium_weight": ("unusually_large_invoice_weight", 1, 5),
    "invoice_amount_high_weight": ("unusually_large_invoice_weight", 1, 10),
}


def with_stock_values(settings: Mapping | None) -> dict:
    """Fill missing business settings with the stock values."""
    given = dict(settings or {})
    return {k: given[k] if given.get(k) not in (None, "") else v for k, v in STOCK_SETTINGS.items()}


def check_business_settings(settings: Mapping | None) -> list[str]:
    """Violations of the threshold and weight rules, after stock values are filled in."""
    values = {key: int(value or 0) for key, value in with_stock_values(settings).items()}
    medium, high = values["medium_risk_threshold"], values["high_risk_threshold"]
    found = []
    if medium < 0 or high < 0:
        found.append("Risk thresholds cannot be negative.")
    if medium >= high:
        found.append("Medium Risk Threshold must be lower than High Risk Threshold.")
    if high > 100:
        found.append("High Risk Threshold cannot be greater than 100.")
    for name in STOCK_SETTINGS:
        if name.endswith("_weight") and values[name] < 0:
            found.append(f"{name.replace('_', ' ').title()} cannot be negative.")
    return found


def settings_from_business(settings: Mapping | None) -> dict[str, float]:
    """Detailed scoring settings for one record of business settings."""
    detail = scoring_settings()
    record = settings or {}
    value = {
        name: number_setting(record.get(name), detail[default]) for name, default in FALLBACK.items()
    }
    detail["medium_risk_threshold"] = value["medium_risk_threshold"]
    detail["high_risk_threshold"] = value["high_risk_threshold"]
    for name, (source, factor, extra) in DERIVED.items():
        weight = value[source] * factor + extra
        detail[name] = float(round(weight)) if factor != 1 else weight
    return detail
