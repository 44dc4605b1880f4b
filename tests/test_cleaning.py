"""Raw export cleaning: one row per rejection reason."""

import pytest

from ledgermill.operators import cleaning
from ledgermill.schemas import RAW_INVOICE_COLUMNS, text_schema

GOOD = dict(
    business_code="U001", customer_id_raw=" C1 ", customer_name_raw="Acme", clear_date_raw="2020-02-11 00:00:00",
    business_year_raw="2020.0", doc_id_raw="1930438491.0", posting_date_raw="2020-01-26",
    document_create_date_raw="20200125", document_create_date_1_raw="20200126", due_date_raw="20200210.0",
    invoice_currency_raw="USD", document_type_raw="RV", posting_id_raw="1.0", area_business_raw="",
    invoice_amount_raw="54273.28", baseline_create_date_raw="20200126.0", payment_terms_raw="NAH4",
    invoice_id_raw="1.0", is_open_raw="0",
)


def raw(spark, *changes):
    rows = [{**GOOD, "invoice_id_raw": f"{n + 1}.0", **change} for n, change in enumerate(changes)]
    return spark.createDataFrame([tuple(r[c] for c in RAW_INVOICE_COLUMNS) for r in rows], text_schema(RAW_INVOICE_COLUMNS))


CASES = [
    ({"invoice_id_raw": ""}, cleaning.MISSING_ID),
    ({"customer_id_raw": "  "}, cleaning.MISSING_CUSTOMER),
    ({"posting_date_raw": "bad"}, cleaning.BAD_POSTING_DATE),
    ({"due_date_raw": "20201301"}, cleaning.BAD_DUE_DATE),
    ({"invoice_amount_raw": "0"}, cleaning.BAD_AMOUNT),
    ({"is_open_raw": "2"}, cleaning.BAD_OPEN_FLAG),
    ({"clear_date_raw": ""}, cleaning.CLOSED_NOT_CLEARED),
    ({"is_open_raw": "1"}, cleaning.OPEN_BUT_CLEARED),
    ({"clear_date_raw": "2020-01-25"}, cleaning.CLEARED_TOO_EARLY),
    ({}, None),
    ({"is_open_raw": ""}, None),
    ({"is_open_raw": "abc"}, None),
]


@pytest.mark.parametrize(("change", "reason"), CASES)
def test_reason(spark, change, reason):
    row = cleaning.review(cleaning.normalize(raw(spark, change))).first()
    assert row["rejection_reason"] == reason


def test_clean_row_and_counts(spark):
    table = raw(spark, {}, *[c for c, _ in CASES]).unionByName(raw(spark, {}))
    reviewed = cleaning.review(cleaning.normalize(table))
    row = cleaning.accept(reviewed).filter("invoice_id = '1'").first()
    assert (row["customer_id"], row["doc_id"], row["business_year"], row["payment_delay_days"], row["is_late"]) == (
        "C1", "1930438491", 2020, 1, 1)
    counts = {r["metric"]: r["value"] for r in cleaning.row_counts(table, reviewed).collect()}
    assert counts == {"raw_rows": 14, "normalized_rows": 13, "clean_rows": 4, "rejected_rows": 9,
                      "labeled_paid_rows": 3, "open_invoice_rows": 0}


def test_repeated_id_stops_the_job(spark):
    table = raw(spark, {"invoice_id_raw": "7"}, {"invoice_id_raw": "7", "invoice_amount_raw": "1"})
    with pytest.raises(ValueError, match="7"):
        cleaning.require_unique_ids(cleaning.clean(table))


def test_views(spark):
    cleaning.register_views(cleaning.clean(raw(spark, {}, {"is_open_raw": "1", "clear_date_raw": ""})))
    assert spark.table("labeled_invoices").count() == 1
    assert spark.table("open_invoices").count() == 1
    assert spark.table("invoice_risk_training_view").columns == cleaning.TRAINING_COLUMNS
