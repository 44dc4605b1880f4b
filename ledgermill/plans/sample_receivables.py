"""Receivables queries over the sample tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    actions,
    assessments,
    audit,
    cleaning,
    constraints,
    customers,
    dashboard,
    importing,
    quality,
    scoring,
    validation,
)
from ..settings import STOCK_SETTINGS, settings_from_business
from ..sources import sample_tables as samples
from . import reports

# The sample's amounts spread little, so a second setting set with lower levels reaches every
# branch of the rules.
LOW_LEVELS = {"medium_risk_threshold": 20, "high_risk_threshold": 45}
AS_OF = "2001-07-01"


class Inputs:
    """The jobs' inputs and intermediate results over one folder of sample tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _mapped(self, text: str) -> DataFrame:
        return samples.mapped(self.spark, self.sf_dir, text)

    def invoices(self):
        return self._mapped(samples.INVOICES)

    def raw(self):
        return self._mapped(samples.RAW_INVOICES)

    def uploads(self):
        return self._mapped(samples.UPLOAD_ROWS)

    def old_assessments(self):
        return self._mapped(samples.OLD_ASSESSMENTS)

    def old_actions(self):
        return self._mapped(samples.OLD_ACTIONS)

    def reviewed(self):
        return cleaning.review(cleaning.normalize(self.raw()))

    def metrics(self):
        return customers.aggregate_customers(self.invoices())

    def stored_customers(self):
        """All customers; those with few invoices under another id, as if not stored yet."""
        known = F.col("total_invoices") > 9
        return self.metrics().withColumn(
            "customer_id", F.when(known, F.col("customer_id")).otherwise(F.concat(F.lit("OLD-"), "customer_id"))
        )

    def stored_invoices(self):
        """All invoices; the closed ones under other ids, as if not stored yet."""
        kept = F.col("is_open") == 1
        return self.invoices().withColumns(
            {name: F.when(kept, F.col(name)).otherwise(F.concat(F.lit("OLD-"), name)) for name in ("invoice_id", "customer_id")}
        )

    def scored(self, settings=LOW_LEVELS):
        return scoring.score_customers(self.metrics(), settings)

    def analysis_date(self):
        return assessments.latest_posting_date(self.invoices())

    def assessed(self, settings=LOW_LEVELS):
        return assessments.assess_open_invoices(
            self.invoices(), self.scored(settings), self.analysis_date(), settings
        )

    def identified(self):
        """Fresh assessments under their own ids, as the first run of a new store has them."""
        return self.assessed().withColumn(
            "assessment_id", F.concat(F.lit("A"), F.col("external_invoice_id"))
        )

    def merged_assessments(self):
        now = F.lit(None).cast("timestamp")
        old = self.old_assessments().withColumn("last_calculated_on", now)
        return assessments.merge_assessments(old, self.assessed(), now)

    def resolved_actions(self):
        return actions.resolve_closed(self.old_actions(), self.old_assessments())

    def validated(self):
        return validation.validate_rows(self.uploads())

    def imported(self):
        return importing.normalize_rows(validation.valid_rows(self.validated()), AS_OF)


def doubles(df: DataFrame) -> DataFrame:
    """Decimal amounts as doubles, for display and comparison."""
    amounts = {n: F.col(n).cast("double") for n, t in df.dtypes if t.startswith("decimal")}
    return df.withColumns(amounts) if amounts else df


def _named_violations(df: DataFrame, key: str, rules) -> DataFrame:
    return constraints.violations(df, key, rules)


def _scoreless(df: DataFrame) -> DataFrame:
    return df.drop("last_calculated_on", "last_updated_on", "calculated_on")


RISK_FIELDS = ["customer_id", "risk_score", "risk_level", "risk_confidence", "risk_explanation"]


def customer_risk(spark, sf_dir):
    return Inputs(spark, sf_dir).scored(None).select(*RISK_FIELDS)


def customer_risk_custom(spark, sf_dir):
    return Inputs(spark, sf_dir).scored(LOW_LEVELS).select(*RISK_FIELDS)


def customer_risk_stock(spark, sf_dir):
    return Inputs(spark, sf_dir).scored(settings_from_business(STOCK_SETTINGS)).select(*RISK_FIELDS)


def assessment_merge(spark, sf_dir):
    merged = Inputs(spark, sf_dir).merged_assessments()
    # New ids are hashes; the comparison names the invoice instead.
    is_new = F.col("merge_status") == "created"
    shown = F.when(is_new, F.concat(F.lit("new:"), "external_invoice_id")).otherwise(F.col("assessment_id"))
    return doubles(_scoreless(merged.withColumn("assessment_id", shown)))


def assessment_close(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return doubles(assessments.close_stale_assessments(i.old_assessments(), i.invoices()))


def actions_new(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    fresh = actions.new_actions(i.identified(), i.resolved_actions(), i.analysis_date())
    return _scoreless(fresh.drop("action_id", "assigned_to"))


def actions_ranked(spark, sf_dir):
    """Action candidates in the order actions are generated, ranked without one task."""
    i = Inputs(spark, sf_dir)
    ranked = actions.generation_ranked(actions.action_candidates(i.identified(), i.analysis_date()))
    return ranked.select("assessment_id", "action_type", "priority", "generation_rank")


def actions_skipped(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    skipped = actions.skipped_actions(i.identified(), i.resolved_actions(), i.analysis_date())
    return skipped.groupBy("action_type", "priority").agg(F.count("*").alias("skipped"))


def audit_customers(spark, sf_dir):
    """Changes against the score and level an earlier run could have stored."""
    number = F.substring("customer_id", 2, 20).cast("bigint")
    before = Inputs(spark, sf_dir).scored(LOW_LEVELS).withColumns(
        {
            "previous_risk_score": F.when(number % 5 == 0, F.col("risk_score"))
            .when(number % 5 == 1, F.lit(None).cast("int"))
            .otherwise((number % 60).cast("int")),
            "previous_risk_level": F.when(number % 5 == 0, F.col("risk_level"))
            .when(number % 5 == 2, F.lit("High")),
        }
    )
    return _scoreless(audit.customer_audit(before))


def audit_assessments(spark, sf_dir):
    merged = Inputs(spark, sf_dir).merged_assessments().filter(F.col("merge_status") == "updated")
    return _scoreless(audit.assessment_audit(merged))


def customer_violations(spark, sf_dir):
    """The customer rules over metrics with some values pushed out of range."""
    number = F.substring("customer_id", 2, 20).cast("bigint")
    bent = Inputs(spark, sf_dir).scored(LOW_LEVELS).withColumns(
        {
            "invoice_count": F.when(number % 7 == 0, F.lit(-1)).otherwise(F.col("total_invoices")),
            "closed_invoice_count": F.when(number % 5 == 0, F.col("total_invoices") + 1).otherwise(
                F.col("closed_invoice_count")
            ),
            "risk_score": F.when(number % 11 == 0, F.lit(101)).otherwise(F.col("risk_score")),
            "risk_level": F.when(number % 13 == 0, F.lit("Severe")).otherwise(F.col("risk_level")),
        }
    )
    return _named_violations(bent, "customer_id", constraints.customer_rules())


def invoice_violations(spark, sf_dir):
    rows = Inputs(spark, sf_dir).imported()
    number = F.col("invoice_id").try_cast("bigint")
    bent = rows.withColumns(
        {
            "invoice_amount": F.when(number % 9 == 0, -F.col("invoice_amount")).otherwise(F.col("invoice_amount")),
            "status": F.when(number % 10 == 0, F.lit("Late")).otherwise(F.col("status")),
        }
    )
    return _named_violations(bent, "invoice_id", constraints.invoice_rules())


def assessment_violations(spark, sf_dir):
    number = F.col("invoice_id").cast("bigint")
    bent = Inputs(spark, sf_dir).old_assessments().withColumns(
        {
            "days_overdue": F.col("days_overdue") - 20,
            "customer_risk_score": F.col("customer_risk_score") + 30,
            "customer_risk_level": F.when(number % 6 == 0, F.lit("None")).otherwise(F.col("customer_risk_level")),
        }
    )
    return _named_violations(bent, "assessment_id", constraints.assessment_rules())


def audit_violations(spark, sf_dir):
    bent = audit_assessments(spark, sf_dir).withColumns(
        {"new_score": F.col("new_score") + 40, "previous_level": F.concat("previous_level", F.lit(""))}
    )
    return _named_violations(bent, "reference_name", constraints.audit_rules())


def action_keys(spark, sf_dir):
    keyed = constraints.with_active_key(Inputs(spark, sf_dir).old_actions())
    return keyed.select("action_id", "status", "active_invoice_key")


def action_duplicates(spark, sf_dir):
    """Active pairs held twice once the old actions meet the ones a naive run would add."""
    i = Inputs(spark, sf_dir)
    added = actions.action_candidates(i.identified(), i.analysis_date()).select(
        "external_invoice_id", "action_type", F.lit("Open").alias("status")
    )
    both = i.old_actions().select("external_invoice_id", "action_type", "status").unionByName(added)
    return constraints.repeated_active_actions(both)


def rpt_customer(spark, sf_dir):
    filters = {"min_open_amount": "1", "min_late_payment_rate": 10, "min_risk_score": "x"}
    return reports.customer_risk_overview(Inputs(spark, sf_dir).scored(), filters)


def rpt_invoice(spark, sf_dir):
    return reports.invoice_collection_priority(
        Inputs(spark, sf_dir).identified(), {"min_days_overdue": 5}
    )


def rpt_actions(spark, sf_dir):
    return reports.collection_action_queue(Inputs(spark, sf_dir).old_actions(), {"priority": " High "})


def kpis(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return dashboard.kpis(i.scored(), i.identified(), i.old_actions())


def top_customers(spark, sf_dir):
    return dashboard.top_customers(Inputs(spark, sf_dir).scored(), 20)


def import_customer_merge(spark, sf_dir):
    """Customers after an import: the last row of each customer names it."""
    i = Inputs(spark, sf_dir)
    merged = importing.merge_customers(i.stored_customers().withColumn("risk_score", F.lit(7)), i.imported())
    return doubles(
        merged.select("customer_id", "customer_name", "business_code", "default_currency",
                      "total_invoices", "open_amount", "risk_score")
    )


def import_invoice_merge(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    stored = i.stored_invoices().withColumns(
        {"status": F.lit("Open"), "imported_on": F.lit(None).cast("timestamp")}
    )
    merged = importing.merge_invoices(stored, i.imported(), F.lit(None).cast("timestamp"))
    return doubles(
        merged.select("invoice_id", "customer_id", "posting_date", "due_date", "clear_date",
                      "invoice_amount", "is_open", "late_payment_status", "days_overdue", "status")
    )


def upsert_counts(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    stored = i.stored_invoices()
    rows = i.imported()
    by_invoice = importing.merge_counts(rows, stored, "invoice_id")
    by_customer = importing.merge_counts(rows, stored.select("customer_id").distinct(), "customer_id")
    return by_invoice.withColumn("entity", F.lit("invoices")).unionByName(
        by_customer.withColumn("entity", F.lit("customers"))
    )


def import_summary(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return customers.invoice_summary(i.invoices(), i.imported())


def _with(make):
    return lambda spark, sf_dir: make(Inputs(spark, sf_dir))


QUERIES = {
    "clean_reasons": _with(lambda i: cleaning.reason_counts(i.reviewed())),
    "clean_invoices": _with(lambda i: cleaning.ordered_for_export(cleaning.accept(i.reviewed()))),
    "clean_row_counts": _with(lambda i: cleaning.row_counts(i.raw(), i.reviewed())),
    "clean_currency_totals": _with(lambda i: cleaning.currency_totals(cleaning.accept(i.reviewed()))),
    "clean_labeled_summary": _with(lambda i: cleaning.labeled_summary(cleaning.accept(i.reviewed()))),
    "clean_labeled": _with(lambda i: cleaning.labeled(cleaning.accept(i.reviewed()))),
    "clean_open": _with(lambda i: cleaning.still_open(cleaning.accept(i.reviewed()))),
    "clean_training_view": _with(lambda i: cleaning.training_view(cleaning.accept(i.reviewed()))),
    "clean_repeated_ids": _with(lambda i: cleaning.repeated_ids(i.reviewed())),
    "csv_row_errors": _with(lambda i: validation.row_errors(i.validated())),
    "csv_totals": _with(lambda i: validation.validation_totals(i.validated())),
    "csv_error_summary": _with(lambda i: validation.error_summary(validation.row_errors(i.validated()))),
    "import_rows": _with(lambda i: doubles(i.imported())),
    "import_customer_merge": import_customer_merge,
    "import_invoice_merge": import_invoice_merge,
    "upsert_counts": upsert_counts,
    "import_summary": import_summary,
    "quality_scorecard": _with(lambda i: quality.invoice_scorecard(i.reviewed())),
    "customer_metrics": _with(lambda i: doubles(i.metrics())),
    "customer_ids": _with(lambda i: customers.customer_ids(i.invoices())),
    "customer_risk": customer_risk,
    "customer_risk_custom": customer_risk_custom,
    "customer_risk_stock": customer_risk_stock,
    "invoice_risk": _with(lambda i: doubles(i.assessed(None))),
    "invoice_risk_custom": _with(lambda i: doubles(i.assessed(LOW_LEVELS))),
    "invoices_without_customer": _with(
        lambda i: assessments.invoices_without_customer(
            i.invoices(), i.stored_customers()
        )
    ),
    "assessment_merge": assessment_merge,
    "assessment_close": assessment_close,
    "actions_new": actions_new,
    "actions_skipped": actions_skipped,
    "actions_ranked": actions_ranked,
    "actions_resolve": _with(lambda i: i.resolved_actions()),
    "audit_customers": audit_customers,
    "audit_assessments": audit_assessments,
    "customer_violations": customer_violations,
    "invoice_violations": invoice_violations,
    "assessment_violations": assessment_violations,
    "audit_violations": audit_violations,
    "action_keys": action_keys,
    "action_duplicates": action_duplicates,
    "rpt_customer": rpt_customer,
    "rpt_invoice": rpt_invoice,
    "rpt_actions": rpt_actions,
    "kpis": kpis,
    "open_by_level": _with(lambda i: dashboard.open_amount_by_level(i.scored())),
    "dist_level": _with(lambda i: dashboard.customers_by_level(i.scored())),
    "aging": _with(lambda i: dashboard.aging(i.assessed())),
    "actions_by_status": _with(lambda i: dashboard.actions_by_status(i.old_actions())),
    "overdue_by_month": _with(lambda i: dashboard.overdue_by_month(i.assessed())),
    "top_customers": top_customers,
}
