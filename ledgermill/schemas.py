"""Column names and types of the stored tables and the input files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One amount, and a sum of amounts (one customer may hold a large part of all invoices).
MONEY = T.DecimalType(18, 2)
MONEY_TOTAL = T.DecimalType(28, 2)

# The raw export, in file order; every field is read as text.
RAW_INVOICE_COLUMNS = [
    "business_code",
    "customer_id_raw",
    "customer_name_raw",
    "clear_date_raw",
    "business_year_raw",
    "doc_id_raw",
    "posting_date_raw",
    "document_create_date_raw",
    "document_create_date_1_raw",
    "due_date_raw",
    "invoice_currency_raw",
    "document_type_raw",
    "posting_id_raw",
    "area_business_raw",
    "invoice_amount_raw",
    "baseline_create_date_raw",
    "payment_terms_raw",
    "invoice_id_raw",
    "is_open_raw",
]

# A cleaned invoice file and the fields an upload must have.
CLEAN_INVOICE_COLUMNS = [
    "business_code",
    "customer_id",
    "customer_name",
    "clear_date",
    "business_year",
    "doc_id",
    "posting_date",
    "document_create_date",
    "document_create_date_1",
    "due_date",
    "currency",
    "document_type",
    "posting_id",
    "invoice_amount",
    "baseline_create_date",
    "payment_terms",
    "invoice_id",
    "is_open",
    "payment_delay_days",
    "is_late",
]
REQUIRED_UPLOAD_COLUMNS = [
    "customer_id",
    "invoice_id",
    "posting_date",
    "due_date",
    "invoice_amount",
    "is_open",
]


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "money": MONEY,
    "money_total": MONEY_TOTAL,
    "texts": T.ArrayType(T.StringType()),
}


def _table(spec: str) -> T.StructType:
    fields = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


INVOICES = _table("""
    invoice_id string, doc_id string, receivables_customer string, customer_id string,
    customer_name string, business_code string, business_year int, posting_date date,
    due_date date, clear_date date, document_create_date date, document_create_date_1 date,
    baseline_create_date date, currency string, document_type string, posting_id int,
    payment_terms string, invoice_amount money, is_open int,
    late_payment_status string, payment_delay_days int, days_overdue int, status string,
    imported_on timestamp
""")

CUSTOMERS = _table("""
    customer_id string, customer_name string, business_code string, default_currency string,
    total_invoices bigint, closed_invoice_count bigint, open_invoice_count bigint,
    total_invoice_amount money_total, open_amount money_total,
    average_payment_delay double, late_payment_rate double,
    risk_score int, risk_level string, risk_confidence string, risk_explanation string,
    invoice_count bigint, first_invoice_date date, last_invoice_date date,
    last_calculated_on timestamp, risk_last_calculated_on timestamp
""")

ASSESSMENTS = _table("""
    assessment_id string, receivables_invoice string, external_invoice_id string,
    invoice_id string, receivables_customer string, customer_id string, customer_name string,
    posting_date date, due_date date, currency string, invoice_amount money,
    is_open int, days_overdue int, customer_risk_score int, customer_risk_level string,
    risk_score int, risk_level string, suggested_action string, explanation string,
    last_calculated_on timestamp
""")

ACTIONS = _table("""
    action_id string, receivables_customer string, receivables_invoice string,
    invoice_risk_assessment string, external_invoice_id string, customer_id string,
    customer_name string, action_type string, priority string, status string,
    assigned_to string, due_date date, notes string, auto_generated int,
    active_invoice_key string, created_from_risk_score int, last_updated_on timestamp
""")

AUDIT = _table("""
    reference_doctype string, reference_name string, entity_type string, customer_id string,
    external_invoice_id string, previous_score int, new_score int, previous_level string,
    new_level string, reason string, source string, calculated_on timestamp
""")

IMPORT_JOBS = _table("""
    status string, as_of_date date, recalculation_status string, total_rows bigint,
    valid_rows bigint, invalid_rows bigint, imported_rows bigint, customers_created bigint,
    customers_updated bigint, invoices_created bigint, invoices_updated bigint,
    customers_summarized bigint, validation_summary string, error_summary string,
    started_on timestamp, completed_on timestamp
""")

# Rows that a job could not use: what they are, as read, and why.
REJECTS = _table("""
    run string, stage string, row_key string, row_text string, messages texts
""")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a table's columns and types; columns the input lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
