"""Payment reports: cleaning, features, labels, issues and the file job."""

import json

from ledgermill.operators import payments
from ledgermill.plans import enrichment_jobs

RAW = {
    "Report Id": "1", "Policy Regime": "Regime 1", "Financial period start date": "2020-01-01",
    "Start date": "2020-01-01", "End date": "2020-06-30", "Filing date": "2020-07-15", "Company": " Acme   plc ",
    "Company number": "123", "Average time to pay": "61", "Total value invoices paid within 30 days": "£1,234.50",
    "Total value invoices paid between 31 and 60 days": "50", "Total value invoices paid later than 60 days": "25",
    "% Invoices paid within 30 days": "70%", "% Invoices paid between 31 and 60 days": "20",
    "% Invoices paid later than 60 days": "10", "Total value invoices paid later than agreed terms": "130.95",
    "% Invoices not paid within agreed terms": "26", "% Invoices not paid due to dispute": "0",
    "Shortest (or only) standard payment period": "30", "Longest standard payment period": "60",
    "Standard payment terms": "Net 30", "Payment terms have changed": "No change", "URL": "https://example.org/1",
}


def cleaned(spark, *changes):
    rows = [{**RAW, **change} for change in changes]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` string" for c in RAW))
    return payments.clean_reports(payments.normalize_columns(frame))


def test_one_report(spark):
    row = payments.flag_issues(payments.build_features(cleaned(spark, {}))).first()
    assert (row["company_name"], row["company_number"], row["value_paid_within_30"]) == ("ACME PLC", "00000123", 1234.5)
    assert row["reporting_period"] == "2020-01-01 to 2020-06-30" and row["reporting_period_length_days"] == 181
    assert row["reported_paid_invoice_value"] == 1309.5 and row["share_value_late_if_available"] == 10.0
    assert (row["payment_speed_score"], row["payment_reliability_score"], row["payment_behavior_score"]) == (39.0, 74.0, 56.5)
    assert (row["slow_payer_label"], row["late_terms_label"], row["public_payment_risk_band"]) == (1, 1, "High")
    assert (row["payment_terms_changed_flag"], row["e_invoicing_offered"]) == ("No", None)
    assert (row["quality_flags"], row["is_rejected"], row["company_reporting_count"]) == ("", False, 1)


def test_bands_labels_and_missing_values(spark):
    rows = cleaned(
        spark,
        {"Average time to pay": "20", "% Invoices not paid within agreed terms": "15"},
        {"Average time to pay": "20", "% Invoices not paid within agreed terms": "5"},
        {"Average time to pay": "None", "% Invoices not paid within agreed terms": "nan",
         "Total value invoices paid later than 60 days": ""},
        {"Average time to pay": "", "% Invoices not paid within agreed terms": "10"},
    )
    out = payments.slow_payer_labels(payments.payment_features(rows)).collect()
    assert [r["public_payment_risk_band"] for r in out] == ["Medium", "Low", "Unknown", "Low"]
    assert [r["slow_payer_label"] for r in out] == [0, 0, None, None]
    assert [r["payment_behavior_score"] for r in out] == [82.5, 87.5, None, 90.0]
    assert out[2]["reported_paid_invoice_value"] is None and out[2]["share_value_late_if_available"] is None


def test_issues(spark):
    rows = cleaned(
        spark,
        {"% Invoices paid within 30 days": "101", "Report Id": "a"},
        {"Average time to pay": "366", "Company number": "9", "Report Id": "b"},
        {"Company number": "", "Report Id": "c"},
        {"Company number": "8", "Total value invoices paid later than 60 days": "(1)",
         "Shortest (or only) standard payment period": "90", "Report Id": "d"},
    )
    out = {r["report_id"]: r for r in payments.flag_issues(payments.build_features(rows)).collect()}
    assert out["a"]["quality_flags"] == "invalid_percentages;payment_bucket_sum_issues"
    assert out["b"]["quality_flags"] == "invalid_average_payment_days"
    assert out["c"]["quality_flags"] == "missing_required_fields" and out["c"]["is_rejected"]
    assert out["d"]["quality_flags"] == "value_bucket_issues;inconsistent_payment_terms"


def test_duplicate_periods_and_counts(spark):
    rows = payments.company_counts(
        cleaned(spark, {}, {}, {"Start date": "2021-01-01"}, {"Company number": ""}, {"Company number": "n/a"})
    ).collect()
    assert sorted((r["company_reporting_count"] or 0, r["period_report_count"]) for r in rows) == [
        (0, 2), (0, 2), (3, 1), (3, 2), (3, 2)]


def test_file_job(spark, tmp_path):
    source = tmp_path / "reports.csv"
    lines = [",".join(json.dumps(v) for v in r.values()) for r in (RAW, {**RAW, "Company number": ""})]
    source.write_text("﻿" + ",".join(f'"{c}"' for c in RAW) + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    result = enrichment_jobs.process_payment_reports(spark, str(source), str(tmp_path / "out"))
    assert {k: result[k] for k in ("cleaned_rows", "flagged_rows", "ml_ready_rows", "rejected_rows")} == {
        "cleaned_rows": 1, "flagged_rows": 1, "ml_ready_rows": 1, "rejected_rows": 1}
    ready = spark.read.parquet(result["outputs"]["ml_ready"])
    assert ready.columns == payments.ML_READY_COLUMNS
    assert ready.first()["original_row_index"] == 0
    report = {(r["section"], r["metric"]): r["value"]
              for r in spark.read.json(result["outputs"]["quality_report"]).collect()}
    assert report["size", "row_count"] == 2 and report["issue_counts", "missing_required_fields"] == 1
    assert report["missingness", "company_number"] == 1


def test_dominant_company_is_split(spark):
    """Counts joined back on a company that files most reports: the final plan splits it."""
    from pyspark.sql import functions as F

    from ledgermill.operators.payments import PERIOD_KEY, company_counts

    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20000).select(
            F.when(F.col("id") % 10 < 8, F.lit("HOT")).otherwise((F.col("id") % 997).cast("string")).alias(PERIOD_KEY[0]),
            *[(F.col("id") % 3).cast("string").alias(k) for k in PERIOD_KEY[1:]],
            F.col("id").alias("report"),
        ).repartition(8)
        counted = company_counts(rows)
        got = counted.filter(F.col(PERIOD_KEY[0]) == "HOT").select("company_reporting_count").distinct().collect()
        assert [r[0] for r in got] == [16000]
        counted.collect()  # runs the plan read below
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_global_rank_over_ranges(spark):
    """Places in a total order from range counts and offsets, across many ranges."""
    import random

    from pyspark.sql import functions as F

    from ledgermill.operators.common import global_rank

    rng = random.Random(9)
    rows = [(rng.choice([None, 5, 5, 5, 7, rng.randint(0, 99)]), rng.randint(0, 3), f"a{k:05d}") for k in range(3000)]
    df = spark.createDataFrame(rows, "risk_score int, days_overdue int, assessment_id string")
    order = [F.col("risk_score").desc_nulls_last(), F.col("days_overdue").desc_nulls_last(), F.col("assessment_id").asc_nulls_first()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["assessment_id"]: r["rank"] for r in global_rank(df, order, "rank").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, -(r[1] or 0), r[2]))
    assert got == {r[2]: k + 1 for k, r in enumerate(want)}
