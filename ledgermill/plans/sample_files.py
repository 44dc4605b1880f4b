"""Sources, sinks and whole jobs over the sample tables: written, read back and compared.

Each query writes to a new place in the shared folder through a sink and returns what a source
reads from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import metrics
from ..operators import cleaning, customers, facts, scoring
from ..sources import csv_files, files
from ..sources import sample_tables as samples
from ..sources.tables import TableStore
from ..session import shared_folder
from . import enrichment_jobs, import_job
from .sample_enrichment import documents, flagged, model_rows, profiles, raw_reports
from .sample_models import scored
from .sample_receivables import AS_OF, Inputs


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _as_csv(df: DataFrame, label: str, *order: str) -> str:
    """Text rows as CSV files whose names follow the order; spaces inside fields are kept."""
    path = _place(df.sparkSession, label)
    writer = df.orderBy(*order).write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def file_raw_invoices(spark, sf_dir):
    """The raw export through its file: cleaned rows come out as from the table."""
    path = _as_csv(Inputs(spark, sf_dir).raw(), "raw", "invoice_id_raw")
    cleaned = cleaning.accept(cleaning.review(cleaning.normalize(csv_files.read_raw_invoices(spark, path, multiline=False))))
    return cleaned.select("invoice_id", "customer_id", "posting_date", "due_date", "clear_date", "is_open", "is_late")


def file_clean_export(spark, sf_dir):
    """The cleaning job's export in file order."""
    raw = _as_csv(Inputs(spark, sf_dir).raw(), "raw", "invoice_id_raw")
    outputs = enrichment_jobs.clean_invoice_export(spark, raw, _place(spark, "clean"))
    rows = csv_files.read_numbered(spark, outputs["cleaned"], multiline=False)
    return rows.select("row_index", "invoice_id", F.col("posting_date").cast("date").alias("posting_date"))


def file_clean_rows(spark, sf_dir):
    """A cleaned file numbered over all its parts."""
    rows = Inputs(spark, sf_dir).uploads().select("row_number", "invoice_id", "customer_id")
    path = _as_csv(rows.withColumnRenamed("row_number", "line"), "upload", "line")
    read = csv_files.read_clean_invoices(spark, path, multiline=False)
    return read.select(
        "row_number", F.col("line").cast("bigint").alias("line"),
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("invoice_id", "customer_id")],
    )


def file_first_rows(spark, sf_dir):
    """The reader's row limit, which is its feature."""
    rows = Inputs(spark, sf_dir).uploads().select(F.col("row_number").alias("line"), "posting_date")
    read = csv_files.read_clean_invoices(spark, _as_csv(rows, "upload", "line"), 25, multiline=False)
    return read.select(F.col("line").cast("bigint").alias("line"), "row_number")


def file_reports(spark, sf_dir):
    """Payment reports numbered from 0, all text, read back from CSV."""
    raw = raw_reports(spark, sf_dir)
    path = _as_csv(raw.select("Report Id", "Company", "Company number"), "reports", "Report Id", "Company number")
    read = csv_files.read_payment_reports(spark, path, multiline=False)
    return read.select(
        "original_row_index", F.col("Report Id").alias("report_id"), F.coalesce("Company number", F.lit("")).alias("company_number")
    )


def file_quoted_reports(spark, sf_dir):
    """Payment reports whose company field spans three lines, read back from CSV in many tasks."""
    raw = raw_reports(spark, sf_dir)
    company = F.concat_ws("\n", "Company", "Report Id", "Company number").alias("Company")
    path = _as_csv(raw.select("Report Id", company, "Company number"), "quoted", "Report Id", "Company number")
    read = csv_files.read_payment_reports(spark, path, multiline=True)
    return read.select(
        "original_row_index", F.col("Report Id").alias("report_id"), F.coalesce("Company", F.lit("")).alias("company")
    )


def file_payment_outputs(spark, sf_dir):
    """Rows of each written payment output."""
    where = _place(spark, "payments")
    rows = flagged(spark, sf_dir)
    outputs = enrichment_jobs.export_payment_outputs(rows.drop("is_rejected", "has_quality_flags", "quality_flags"), where)["outputs"]
    found = [
        spark.read.parquet(outputs[name]).agg(F.lit(name).alias("output"), F.count("*").alias("rows"))
        for name in ("reviewed", "cleaned", "flagged_rows", "ml_ready")
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def file_ml_ready(spark, sf_dir):
    """Model-ready rows through CSV: the company number stays text."""
    path = f"{_place(spark, 'ready')}/rows.csv"
    files.write_table(model_rows(spark, sf_dir), path, "csv")
    return csv_files.read_ml_ready(spark, path).groupBy("company_number").agg(
        F.count("*").alias("rows"), F.sum(F.col("slow_payer_label").cast("double").cast("bigint")).alias("slow")
    )


def file_profiles(spark, sf_dir):
    """Company profiles through CSV."""
    path = f"{_place(spark, 'profiles')}/profiles.csv"
    files.write_table(profiles(spark, sf_dir), path, "csv")
    read = csv_files.read_profiles(spark, path)
    return read.select(F.col("l_suppkey").cast("bigint").alias("l_suppkey"), "cik", "entity_name", "sec_financial_risk_band")


def file_profile_quality(spark, sf_dir):
    """The quality summary job: profiles from Parquet, summary as JSON."""
    path = files.write_table(profiles(spark, sf_dir), _place(spark, "profiles"))
    summary = enrichment_jobs.company_fact_quality(spark, path, _place(spark, "quality"))
    return summary.select(*facts.quality_summary(profiles(spark, sf_dir)).columns)


def file_review_export(spark, sf_dir):
    """The review export: the first 50 customers, which is its feature."""
    people = scoring.score_customers(Inputs(spark, sf_dir).metrics())
    for name in ("last_calculated_on", "risk_last_calculated_on"):
        people = people.withColumn(name, F.lit(None).cast("timestamp"))
    path = _place(spark, "review")
    enrichment_jobs.export_first_customers(people, path)
    return spark.read.option("header", True).csv(path).select(
        "customer_id", F.col("total_invoices").cast("bigint").alias("total_invoices")
    )


def file_thresholds(spark, sf_dir):
    """The threshold report through CSV, and a record through JSON."""
    path = files.write_table(metrics.threshold_report(scored(spark, sf_dir)).coalesce(1), _place(spark, "thresholds"), "csv")
    read = spark.read.option("header", True).csv(path)
    record = files.read_json(spark, files.write_json(spark, {"rows": read.count()}, _place(spark, "record")))
    return read.select(
        F.col("threshold").cast("double").alias("threshold"), F.col("true_positive").cast("bigint").alias("true_positive"),
        F.lit(record["rows"]).cast("bigint").alias("report_rows"),
    )


def import_rejects(spark, sf_dir):
    """What an import of unchecked rows sets aside, with the reasons."""
    i = Inputs(spark, sf_dir)
    store = TableStore(spark, _place(spark, "store"))
    import_job.import_rows(store, store.stage(i.uploads(), "read", "r"), AS_OF, F.lit(None).cast("timestamp"), "r")
    return store.read_appended("rejects").select(
        "stage", F.col("row_key").cast("bigint").alias("row_number"), F.array_join("messages", "; ").alias("messages")
    )


def import_job_counts(spark, sf_dir):
    """The import job from file to stored tables: its recorded row and what the tables hold."""
    path = _as_csv(Inputs(spark, sf_dir).uploads().drop("row_number").withColumn("line", F.col("invoice_id")), "job", "doc_id")
    store = TableStore(spark, _place(spark, "store"))
    import_job.run_import_job(store, path, AS_OF)
    stored = store.read("invoices").agg(F.count("*").alias("stored_invoices"))
    people = store.read("customers").agg(F.count("*").alias("stored_customers"))
    job = store.read_appended("import_jobs").select(
        "status", "recalculation_status", "total_rows", "valid_rows", "invalid_rows", "imported_rows", "customers_created"
    )
    return job.withColumns({"stored_invoices": stored.scalar(), "stored_customers": people.scalar()})


QUERIES = {
    "file_raw_invoices": file_raw_invoices,
    "file_clean_export": file_clean_export,
    "file_clean_rows": file_clean_rows,
    "file_first_rows": file_first_rows,
    "file_reports": file_reports,
    "file_quoted_reports": file_quoted_reports,
    "file_payment_outputs": file_payment_outputs,
    "file_ml_ready": file_ml_ready,
    "file_profiles": file_profiles,
    "file_profile_quality": file_profile_quality,
    "file_review_export": file_review_export,
    "file_thresholds": file_thresholds,
    "import_rejects": import_rejects,
    "import_job_counts": import_job_counts,
}
