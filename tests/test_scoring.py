"""Scores, levels and texts on the worked examples."""

import pytest
from pyspark.sql import functions as F

from ledgermill import settings
from ledgermill.functions import risk
from ledgermill.operators import scoring

CUSTOMER = (
    "total_invoices bigint, closed_invoice_count bigint, open_invoice_count bigint, total_invoice_amount double,"
    " open_amount double, average_payment_delay double, late_payment_rate double"
)
INVOICE = "days_overdue int, invoice_amount double, average_invoice_amount double, customer_risk_level string"


@pytest.mark.parametrize(
    ("row", "overrides", "expected"),
    [
        ((10, 10, 0, 10000.0, 0.0, 1.0, 5.0), None, (0, "Low", "High")),
        ((10, 8, 3, 10000.0, 4000.0, 8.0, 35.0), None, (52, "Medium", "Medium")),
        ((100, 80, 10, 100000.0, 60000.0, 20.0, 60.0), None, (80, "High", "High")),
        ((2, 2, 0, 2000.0, 0.0, 20.0, 60.0), None, (25, "Low", "Low")),
        ((10, 10, 0, 10000.0, 0.0, 1.0, 60.0), {"customer_late_payment_high_weight": 40}, (40, "Medium", "High")),
        ((None, None, None, None, None, None, None), None, (10, "Low", "Low")),
    ],
)
def test_customer_score(spark, row, overrides, expected):
    out = scoring.score_customers(spark.createDataFrame([row], CUSTOMER), overrides).first()
    assert (out["risk_score"], out["risk_level"], out["risk_confidence"]) == expected


def test_customer_texts(spark):
    rows = [(10, 10, 0, 10000.0, 0.0, 1.0, 5.0), (2, 2, 1, 2000.0, 5000.0, 20.0, 60.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + CUSTOMER)
    plain, full = [r["risk_explanation"] for r in scoring.score_customers(frame).orderBy("i").collect()]
    assert plain == "No risk rules were triggered. Customer is classified as Low risk."
    assert full == (
        "Late payment rate is high at 60.0%, adding 25 points. "
        "Average payment delay is high at 20.0 days, adding 20 points. "
        "Payment history is limited, so confidence is low and payment behavior risk is capped at 25 points. "
        "Customer has 1 open invoice, adding 5 points. "
        "Open amount is more than three times the customer's average invoice amount, adding 15 points. "
        "Final classification: Medium risk."
    )


@pytest.mark.parametrize(
    ("row", "overrides", "expected"),
    [
        ((0, 100.0, 100.0, "Low"), None, (0, "Low", "Monitor")),
        ((35, 100.0, 100.0, "Medium"), None, (40, "Medium", "Send Reminder")),
        ((61, 200.0, 100.0, "High"), None, (75, "High", "Escalate Collection")),
        ((0, 400.0, 100.0, "Low"), None, (15, "Low", "Monitor")),
        ((35, 600.0, 100.0, "High"), None, (75, "High", "Escalate Collection")),
        ((11, 100.0, 100.0, "Low"), {"invoice_overdue_low_days": 10, "invoice_overdue_low_weight": 40},
         (40, "Medium", "Send Reminder")),
        ((0, 600.0, 100.0, "High"), {"invoice_customer_high_risk_weight": 60}, (80, "High", "Immediate Follow-up")),
    ],
)
def test_invoice_score(spark, row, overrides, expected):
    out = scoring.score_invoices(spark.createDataFrame([row], INVOICE), overrides).first()
    assert (out["risk_score"], out["risk_level"], out["suggested_action"]) == expected


def test_invoice_text(spark):
    rows = [(0, 1.0, 0.0, None), (16, 151.0, 100.0, "Low")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + INVOICE)
    none, some = [r["explanation"] for r in scoring.score_invoices(frame).orderBy("i").collect()]
    assert none == (
        "No invoice risk rules were triggered. Invoice is classified as Low risk. Suggested action: Monitor."
    )
    assert some == (
        "Invoice is 16.0 days overdue, adding 15 points. Customer risk level is Low, adding 0 points. "
        "Invoice amount is more than 1.5 times the customer's average invoice amount, adding 10 points. "
        "Final classification: Low risk. Suggested action: Monitor."
    )


def test_scoring_stays_in_one_generated_stage(spark):
    frame = spark.range(100).select(
        *[F.col("id").cast(part.split()[1]).alias(part.split()[0]) for part in CUSTOMER.split(", ")]
    )
    plan = scoring.score_customers(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_business_settings():
    detail = settings.settings_from_business(settings.STOCK_SETTINGS)
    assert detail["customer_late_payment_high_weight"] == 30
    assert [detail[f"invoice_overdue_{k}_weight"] for k in ("any", "low", "medium", "high")] == [8, 15, 30, 40]
    assert detail["customer_open_amount_medium_weight"] == 15
    # Halves round to the even neighbour.
    assert settings.settings_from_business({"overdue_weight": 10})["invoice_overdue_any_weight"] == 2
    assert settings.settings_from_business({"overdue_weight": 14})["invoice_overdue_any_weight"] == 4
    assert settings.settings_from_business(None) == {**risk.scoring_settings(), "customer_late_payment_high_weight": 25,
        "invoice_overdue_any_weight": 6, "invoice_overdue_low_weight": 12}
    assert settings.check_business_settings({}) == []
    assert settings.check_business_settings({"medium_risk_threshold": 80}) == [
        "Medium Risk Threshold must be lower than High Risk Threshold."
    ]
    assert settings.check_business_settings({"overdue_weight": -1, "high_risk_threshold": 101}) == [
        "High Risk Threshold cannot be greater than 100.",
        "Overdue Weight cannot be negative.",
    ]


def test_unknown_and_bad_settings():
    merged = risk.scoring_settings({"no_such_key": 1, "high_risk_threshold": "x"})
    assert "no_such_key" not in merged and merged["high_risk_threshold"] == 0
