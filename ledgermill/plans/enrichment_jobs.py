"""Payment-report, company-fact, invoice-cleaning and review-export jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, facts, payments
from ..operators.common import reject_rows
from ..sources import csv_files, documents, files

# The fields of the review export.
REVIEW_FIELDS = [
    "customer_id",
    "customer_name",
    "business_code",
    "default_currency",
    "total_invoices",
    "closed_invoice_count",
    "open_invoice_count",
    "total_invoice_amount",
    "open_amount",
    "average_payment_delay",
    "late_payment_rate",
    "risk_score",
    "risk_level",
    "risk_explanation",
    "last_calculated_on",
    "risk_last_calculated_on",
]


def clean_invoice_export(spark: SparkSession, input_path: str, output_dir: str) -> dict:
    """Clean a raw export: reviewed rows, cleaned CSV in posting order, and the reports.

    Reviewed rows are written once; the export and every report read that table.
    """
    raw = csv_files.read_raw_invoices(spark, input_path)
    path = files.write_table(cleaning.review(cleaning.normalize(raw)), f"{output_dir}/invoice_review")
    reviewed = spark.read.parquet(path)
    cleaned = cleaning.accept(reviewed)
    cleaning.require_unique_ids(cleaned)
    cleaning.register_views(cleaned)
    return {
        "reviewed": path,
        "cleaned": files.write_table(cleaning.ordered_for_export(cleaned), f"{output_dir}/dataset_clean", "csv"),
        "row_counts": cleaning.row_counts(raw, reviewed),
        "reason_counts": cleaning.reason_counts(reviewed),
        "currency_totals": cleaning.currency_totals(cleaned),
        "labeled_summary": cleaning.labeled_summary(cleaned),
    }


def export_payment_outputs(features: DataFrame, output_dir: str, file_format: str = "parquet") -> dict:
    """Write reviewed, cleaned, flagged and model-ready rows and the quality report."""
    spark = features.sparkSession
    files.write_table(payments.flag_issues(features), f"{output_dir}/public_payment_reviewed")
    flagged = spark.read.parquet(f"{output_dir}/public_payment_reviewed")
    outputs = {"reviewed": f"{output_dir}/public_payment_reviewed"}
    for name, df in payments.output_frames(flagged).items():
        shown = df.drop("period_report_count")
        outputs[name] = files.write_table(shown, f"{output_dir}/public_payment_{name}", file_format)
    report = payments.quality_report(flagged)
    outputs["quality_report"] = files.write_table(report.coalesce(1), f"{output_dir}/public_payment_quality_report", "json")
    counts = {
        row["metric"]: row["value"]
        for row in spark.read.json(outputs["quality_report"]).filter("section = 'output_counts'").collect()
    }
    return {**counts, "outputs": outputs}


def process_payment_reports(
    spark: SparkSession, input_path: str | Sequence[str], output_dir: str, file_format: str = "parquet"
) -> dict:
    raw = csv_files.read_payment_reports(spark, input_path)
    cleaned = payments.clean_reports(payments.normalize_columns(raw))
    return export_payment_outputs(payments.build_features(cleaned), output_dir, file_format)


def build_profiles(spark: SparkSession, input_path: str, limit: int | None = None) -> DataFrame:
    texts = documents.read_documents(spark, input_path, limit)
    return facts.company_profiles(facts.parse_documents(texts))


def document_rejects(spark: SparkSession, input_path: str, limit: int | None = None) -> DataFrame:
    """Documents that are not JSON, in the form of the rejects table."""
    parsed = facts.parse_documents(documents.read_documents(spark, input_path, limit))
    bad = facts.unreadable_documents(parsed).select("name", F.col("document.unreadable").alias("text"), "problems")
    return reject_rows(bad, "documents", "name", "problems")


def process_company_facts(
    spark: SparkSession, input_path: str, output_path: str, limit: int | None = None, file_format: str = "parquet"
) -> dict:
    path = files.write_table(build_profiles(spark, input_path, limit), output_path, file_format)
    rejects = files.write_table(document_rejects(spark, input_path, limit), f"{output_path}_rejects")
    stored = spark.read.option("header", True).format(file_format).load(path)
    return {
        "input_path": str(input_path),
        "output_path": path,
        "companies_processed": stored.count(),
        "documents_rejected": spark.read.parquet(rejects).count(),
        "rejects_path": rejects,
        "columns": facts.PROFILE_COLUMNS,
    }


def company_fact_quality(spark: SparkSession, profiles_path: str, output_path: str) -> DataFrame:
    """Write the quality summary of stored profiles as JSON rows and return it."""
    summary = facts.quality_summary(csv_files.read_profiles(spark, profiles_path))
    files.write_table(summary.coalesce(1), output_path, "json")
    return spark.read.json(output_path)


def export_first_customers(customers: DataFrame, output_path: str, limit: int = 50) -> dict:
    """The first customers by id, for review."""
    first = customers.select(*REVIEW_FIELDS).orderBy("customer_id").limit(int(limit))
    files.write_table(first.coalesce(1), output_path, "csv")
    rows = customers.sparkSession.read.option("header", True).csv(output_path).agg(F.count("*")).first()[0]
    return {"output_path": output_path, "rows_exported": rows}
