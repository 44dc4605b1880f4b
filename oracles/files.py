"""DuckDB SQL for what the file queries must read back: the tables before they were written."""

from __future__ import annotations

from . import enrichment, models, receivables
from .receivables import CLEAN, UPLOAD, _from, _number, _strip

_PROBLEMS = [(f"{_strip('customer_id')} is null", "Cannot import row without customer_id"),
             (f"{_strip('invoice_id')} is null", "Cannot import row without invoice_id")]
_PROBLEMS += [(f"{_strip(n)} is not null and ({_number(n)}) is null", f"Invalid {n}")
              for n in ("business_year", "posting_id", "payment_delay_days", "is_late", "invoice_amount", "is_open")]
_MESSAGES = "concat_ws('; ', " + ", ".join(f"case when {test} then '{text}' end" for test, text in _PROBLEMS) + ")"


def _sub(sql: str, query: str) -> str:
    return query.replace("{t}", f"({sql})")


ORACLES = {
    "file_raw_invoices": _from(
        "select invoice_id, customer_id, posting_date, due_date, clear_date, is_open, is_late from clean", CLEAN),
    "file_clean_export": _from(
        "select row_number() over (order by posting_date, invoice_id) - 1 as row_index, invoice_id, posting_date from clean", CLEAN),
    "file_clean_rows": _from("""
select row_number() over (order by row_number) + 1 as row_number, row_number as line,
  coalesce(invoice_id, '') as invoice_id, coalesce(customer_id, '') as customer_id from uploads"""),
    "file_first_rows": _from("""
select row_number as line, row_number() over (order by row_number) + 1 as row_number from uploads
order by line limit 25"""),
    "file_reports": enrichment._WITH + """
select row_number() over (order by "Report Id", "Company number") - 1 as original_row_index, "Report Id" as report_id,
  coalesce("Company number", '') as company_number from raw""",
    "file_quoted_reports": enrichment._WITH + """
select row_number() over (order by "Report Id", "Company number") - 1 as original_row_index, "Report Id" as report_id,
  coalesce(concat_ws(chr(10), "Company", "Report Id", "Company number"), '') as company from raw""",
    "file_payment_outputs": enrichment._WITH + """
select 'reviewed' as output, count(*) as rows from flagged
union all select 'cleaned', count(*) from flagged where not is_rejected
union all select 'flagged_rows', count(*) from flagged where is_rejected or has_quality_flags
union all select 'ml_ready', count(*) from flagged where not is_rejected""",
    "file_ml_ready": _sub(enrichment.ORACLES["pub_ml_ready"], """
select company_number, count(*) as rows, cast(sum(slow_payer_label) as bigint) as slow from {t} as t group by 1"""),
    "file_profiles": _sub(enrichment.ORACLES["sec_profile"], """
select l_suppkey, cik, entity_name, sec_financial_risk_band from {t} as t"""),
    "file_profile_quality": enrichment.ORACLES["sec_quality"],
    "file_review_export": _from("""
select customer_id, total_invoices from metrics order by customer_id limit 50""", receivables.CUSTOMERS),
    "file_thresholds": _sub(models.ORACLES["thresholds"], """
select threshold, true_positive, count(*) over () as report_rows from {t} as t"""),
    "import_rejects": _from(f"""
select * from (select 'import' as stage, row_number, {_MESSAGES} as messages from uploads) as m where messages <> ''"""),
    "import_job_counts": _from("""
select case when count(*) filter (len(errors) > 0) > 0 then 'Completed With Errors' else 'Completed' end as status,
  'Completed' as recalculation_status, count(*) as total_rows, count(*) filter (len(errors) = 0) as valid_rows,
  count(*) filter (len(errors) > 0) as invalid_rows, count(*) filter (len(errors) = 0) as imported_rows,
  count(distinct trim(customer_id)) filter (len(errors) = 0) as customers_created,
  count(distinct trim(invoice_id)) filter (len(errors) = 0) as stored_invoices,
  count(distinct trim(customer_id)) filter (len(errors) = 0) as stored_customers
from validated""", UPLOAD),
}
