"""The import job: validate an upload, import its valid rows, recalculate, record the job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import constraints, customers, importing, validation
from ..operators.common import reject_rows, settle
from ..schemas import CUSTOMERS, IMPORT_JOBS
from ..sources import csv_files
from ..sources.tables import TableStore
from .recalculation import recalculate, run_clock

RECALCULATION_STATUS = {
    "success": "Completed",
    "completed_with_errors": "Completed With Errors",
}


def import_rows(store: TableStore, rows: DataFrame, as_of: str, run_at: Column, run: str) -> dict:
    """Merge cleaned text rows into invoices and customers; counts follow the rows.

    Rows that cannot be stored go to the rejects table instead of ending the import.
    """
    checked = settle(importing.import_problems(rows), "problems")
    bad = checked.filter(F.size("problems") > 0)
    typed = importing.normalize_rows(checked.filter(F.size("problems") == 0).drop("problems"), as_of)
    # Typed and checked once; both sides are read from there.
    judged = store.stage(constraints.check_rows(typed, constraints.invoice_rules()), "rows", run)
    staged, broken = constraints.split_checked(judged)
    rejects = store.append(
        "rejects",
        reject_rows(bad, "import", "row_number", "problems").unionByName(
            reject_rows(broken, "import", "row_number", "violations")
        ),
        f"{run}-import",
    )

    people, invoices = store.read("customers"), store.read("invoices")
    made_people = importing.merge_counts(staged, people, "customer_id").first()
    made_invoices = importing.merge_counts(staged, invoices, "invoice_id").first()
    # Only the partitions that hold imported keys are read and rewritten.
    store.merge("invoices", staged.select("invoice_id"), lambda now: importing.merge_invoices(now, staged, run_at), run)
    touched = staged.select("customer_id").distinct()
    summary = customers.invoice_summary(store.read("invoices"), touched)
    store.merge(
        "customers",
        touched,
        lambda now: importing.upsert(importing.merge_customers(now, staged), summary, "customer_id", CUSTOMERS),
        run,
    )
    return {
        "rows_seen": made_invoices["created"] + made_invoices["updated"],
        "customers_created": made_people["created"],
        "customers_updated": made_people["updated"],
        "invoices_created": made_invoices["created"],
        "invoices_updated": made_invoices["updated"],
        "customers_summarized": touched.count(),
        "rows_rejected": rejects.count(),
    }


def import_dataset(
    store: TableStore,
    path: str | Sequence[str],
    limit: int | None = None,
    as_of: str = importing.DEFAULT_AS_OF,
    run_at: datetime | None = None,
    multiline: bool = False,
) -> dict:
    """Import a cleaned invoice file, or its first rows; ``multiline`` if fields hold line breaks."""
    clock, run = run_clock(run_at)
    rows = csv_files.read_clean_invoices(store.spark, path, limit, multiline, store.staging("tagged", run))
    return import_rows(store, store.stage(rows, "read", run), as_of, clock, run)


def validate_upload(
    store: TableStore, path: str | Sequence[str], run: str, multiline: bool = False
) -> tuple[dict, DataFrame | None]:
    """(totals with status and error summary, validated rows); no rows when the header is bad."""
    rows = csv_files.read_upload(store.spark, path, multiline, store.staging("tagged", run))
    missing = validation.header_errors(rows.columns)
    if missing:
        totals = {"total_rows": 0, "valid_rows": 0, "invalid_rows": 0, "error_count": len(missing),
                  "status": "Validation Failed", "error_summary": "\n".join(missing),
                  "validation_summary": "Total rows: 0\nValid rows: 0\nInvalid rows: 0"}
        return totals, None
    validated = store.stage(validation.validate_rows(rows), "validated", run)
    totals = validation.validation_totals(validated).first().asDict()
    summary = validation.error_summary(validation.row_errors(validated)).first()
    return {**totals, "error_summary": summary["error_summary"]}, validated


def _record(store: TableStore, run: str, job: dict) -> None:
    row = tuple(job.get(name) for name in IMPORT_JOBS.fieldNames())
    store.append("import_jobs", store.spark.createDataFrame([row], IMPORT_JOBS), run)


def run_import_job(
    store: TableStore,
    path: str | Sequence[str],
    as_of: str = importing.DEFAULT_AS_OF,
    settings: Mapping | None = None,
    run_at: datetime | None = None,
    multiline: bool = False,
) -> dict:
    """Validate, import, recalculate; the job's row ends in import_jobs whatever happens."""
    started = run_at or datetime.now()
    clock, run = run_clock(started)
    totals, validated = validate_upload(store, path, run, multiline)
    job = {
        **{k: totals[k] for k in ("total_rows", "valid_rows", "invalid_rows", "validation_summary",
                                  "error_summary", "status")},
        "as_of_date": datetime.strptime(as_of, "%Y-%m-%d").date(),
        "recalculation_status": "Not Started",
        "started_on": started,
    }
    if totals["valid_rows"] == 0:
        _record(store, run, {**job, "status": "Validation Failed", "completed_on": datetime.now()})
        raise ValueError("No valid rows found. Fix the CSV file before importing.")
    try:
        imported = import_rows(store, validation.valid_rows(validated), as_of, clock, run)
        recalculated = recalculate(store, settings, run_at=started)
    except Exception:
        _record(store, run, {**job, "status": "Failed", "completed_on": datetime.now(),
                             "error_summary": "Import failed. Check Error Log for technical details."})
        raise
    partly = totals["invalid_rows"] > 0 or recalculated["status"] == "completed_with_errors"
    job.update(
        status="Completed With Errors" if partly else "Completed",
        recalculation_status=RECALCULATION_STATUS.get(recalculated["status"], "Failed"),
        imported_rows=totals["valid_rows"],
        completed_on=datetime.now(),
        **{k: imported[k] for k in ("customers_created", "customers_updated", "invoices_created",
                                    "invoices_updated", "customers_summarized")},
    )
    _record(store, run, job)
    store.clear_staging(run)
    return {"validation": totals, "import": imported, "recalculation": recalculated, "status": job["status"]}
