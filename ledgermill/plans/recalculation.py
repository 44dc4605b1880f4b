"""The recalculation job: aggregate customers, score them, assess invoices, derive actions.

Each step reads stored tables, writes one snapshot and counts its result from that snapshot,
so nothing is computed twice and a failed step can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import actions, assessments, audit, constraints, customers, importing, scoring
from ..operators.common import reject_rows
from ..schemas import ACTIONS, CUSTOMERS
from ..sources.tables import TableStore

STEPS = (
    ("customer_aggregation", "Customer aggregation"),
    ("customer_risk_scoring", "Customer risk scoring"),
    ("invoice_risk_assessment", "Invoice risk assessment"),
    ("collection_action_generation", "Collection action generation"),
)

NO_CUSTOMER = "Customer of the invoice is not stored"


def run_clock(run_at: datetime | None) -> tuple[Column, str]:
    """The run's timestamp as a literal and as a folder-safe id."""
    moment = run_at or datetime.now(timezone.utc)
    text = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp"), moment.strftime("%Y%m%dT%H%M%S%f")


def _changes(stored: DataFrame) -> dict[str, int]:
    return {row["change"]: row["n"] for row in stored.groupBy("change").agg(F.count("*").alias("n")).collect()}


def aggregate_step(store: TableStore, run_at: Column, limit: int | None = None) -> dict:
    """Metrics of every customer merged into the customers table."""
    metrics = customers.aggregate_customers(store.read("invoices"), limit)
    metrics = metrics.withColumn("invoice_count", F.col("total_invoices"))
    merged = importing.upsert(
        store.read("customers"), metrics, "customer_id", CUSTOMERS, {"last_calculated_on": run_at}
    )
    counted = _changes(store.replace("customers", merged))
    created, updated = counted.get("created", 0), counted.get("updated", 0)
    return {
        "customers_seen": created + updated,
        "customers_created": created,
        "customers_updated": updated,
    }


def scoring_step(store: TableStore, settings: Mapping | None, run_at: Column, run: str) -> dict:
    """Risk of every customer, with an audit row where score or level changed."""
    before = store.read("customers").withColumns(
        {"previous_risk_score": F.col("risk_score"), "previous_risk_level": F.col("risk_level")}
    )
    scored = scoring.score_customers(before, settings).withColumn("risk_last_calculated_on", run_at)
    stored = store.replace("customers", scored)
    store.append("audit", audit.customer_audit(stored, run_at), f"{run}-customers")
    count = stored.count()
    return {"customers_processed": count, "customers_updated": count}


def assessment_step(
    store: TableStore, settings: Mapping | None, on: date, run_at: Column, run: str
) -> dict:
    """Assessments of open invoices, then closing of those whose invoice is paid."""
    invoices, people = store.read("invoices"), store.read("customers")
    fresh, rejected = constraints.split_valid(
        assessments.assess_open_invoices(invoices, people, on, settings), constraints.assessment_rules()
    )
    merged = assessments.merge_assessments(store.read("assessments"), fresh, run_at)
    closed = assessments.close_stale_assessments(merged, invoices, run_at)
    change = F.when(F.col("closed_now"), F.lit("closed")).otherwise(F.col("merge_status"))
    stored = store.replace("assessments", closed.withColumn("change", change))
    store.append(
        "audit", audit.assessment_audit(stored.filter(F.col("change") != "kept"), run_at), f"{run}-assessments"
    )
    alone = assessments.invoices_without_customer(invoices, people).withColumn("problems", F.array(F.lit(NO_CUSTOMER)))
    rejects = reject_rows(alone, "assessment", "invoice_id", "problems").unionByName(
        reject_rows(rejected, "assessment", "invoice_id", "violations")
    )
    lost = store.append("rejects", rejects, f"{run}-assessments").count()
    counted = _changes(stored)
    created, updated = counted.get("created", 0), counted.get("updated", 0)
    return {
        "analysis_date": str(on),
        "open_invoices_processed": created + updated + lost,
        "assessments_created": created,
        "assessments_updated": updated,
        "closed_assessment_cleanup": {
            "closed_assessments_found": counted.get("closed", 0),
            "closed_assessments_updated": counted.get("closed", 0),
        },
        "errors": lost,
    }


def action_step(store: TableStore, on: date, run_at: Column) -> dict:
    """Resolve actions of closed assessments, then add the ones now called for."""
    assessed, current = store.read("assessments"), store.read("actions")
    resolved = actions.resolve_closed(current, assessed, run_at)
    change = F.when(F.col("resolved_now"), "resolved").otherwise("kept")
    kept = resolved.withColumn("change", change).drop("resolved_now")
    fresh = actions.new_actions(assessed, resolved, on, run_at).withColumn("change", F.lit("created"))
    columns = [*ACTIONS.fieldNames(), "change"]
    stored = store.replace("actions", kept.select(*columns).unionByName(fresh.select(*columns)))
    counted = _changes(stored)
    wanted = actions.action_candidates(assessed, on).count()
    created = counted.get("created", 0)
    return {
        "analysis_date": str(on),
        "closed_invoice_actions_resolved": {
            "actions_found": counted.get("resolved", 0),
            "actions_resolved": counted.get("resolved", 0),
        },
        "assessments_processed": wanted,
        "actions_created": created,
        "actions_skipped_existing": wanted - created,
    }


def recalculate(
    store: TableStore,
    settings: Mapping | None = None,
    analysis_date: date | None = None,
    run_at: datetime | None = None,
    limit: int | None = None,
) -> dict:
    """Run the four steps in order; a failing step ends the run and is named in the summary."""
    clock, run = run_clock(run_at)

    def day() -> date:
        return analysis_date or assessments.analysis_date_of(store.read("invoices"))

    work: dict[str, Callable[[], dict]] = {
        "customer_aggregation": lambda: aggregate_step(store, clock, limit),
        "customer_risk_scoring": lambda: scoring_step(store, settings, clock, run),
        "invoice_risk_assessment": lambda: assessment_step(store, settings, day(), clock, run),
        "collection_action_generation": lambda: action_step(store, day(), clock),
    }
    summary: dict = {"status": "running", "has_errors": False, **dict.fromkeys(work)}
    for key, label in STEPS:
        try:
            result = work[key]()
        except Exception as error:  # noqa: BLE001 - the summary reports the failed step
            return {**summary, "status": "failed", "failed_step": key, "error": str(error)}
        failed_rows = result.get("errors", 0) > 0  # the rows a step rejected
        summary[key] = {"step": key, "label": label, "result": result, "has_errors": failed_rows}
        summary["has_errors"] = summary["has_errors"] or failed_rows
    summary["status"] = "completed_with_errors" if summary["has_errors"] else "success"
    return summary
