"""Payment-report and company-fact queries over the sample tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, payments
from ..sources import sample_tables as samples


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.mapped(spark, sf_dir, samples.PAYMENT_REPORTS)


def cleaned(spark, sf_dir):
    return payments.clean_reports(payments.normalize_columns(raw_reports(spark, sf_dir)))


def labeled(spark, sf_dir):
    return payments.build_features(cleaned(spark, sf_dir))


def flagged(spark, sf_dir):
    return payments.flag_issues(labeled(spark, sf_dir))


def model_rows(spark, sf_dir):
    """The model-ready rows of the payment job."""
    return payments.output_frames(flagged(spark, sf_dir))["ml_ready"]


def pub_clean(spark, sf_dir):
    names = [n for n in payments.COLUMN_NAMES.values()]
    extra = [
        "payment_terms_changed_flag", "payment_terms_changed_covid_related",
        "payment_terms_changed_policy_related", "payment_terms_changed_supplier_related",
        "reporting_period", "reporting_period_length_days", "has_value_bucket_data", "has_terms_data",
    ]
    return cleaned(spark, sf_dir).select(*names, *extra)


def pub_features(spark, sf_dir):
    return payments.payment_features(cleaned(spark, sf_dir)).select(
        "report_id", "reported_paid_invoice_value", "late_payment_value", "value_paid_later_than_60",
        "share_value_late_if_available", "payment_speed_score", "payment_reliability_score",
        "payment_behavior_score", "public_payment_risk_band",
    )


def pub_labels(spark, sf_dir):
    return payments.slow_payer_labels(cleaned(spark, sf_dir)).select(
        "report_id", "avg_days_to_pay", "pct_not_paid_within_terms", "slow_payer_label", "late_terms_label"
    )


def pub_dupes(spark, sf_dir):
    return payments.company_counts(cleaned(spark, sf_dir)).select(
        "report_id", "company_number", "company_reporting_count", "period_report_count"
    )


def pub_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("report_id", "is_rejected", "has_quality_flags", "quality_flags")


def pub_ml_ready(spark, sf_dir):
    return model_rows(spark, sf_dir)


def pub_flagged_rows(spark, sf_dir):
    rows = payments.output_frames(flagged(spark, sf_dir))["flagged_rows"]
    return rows.groupBy("quality_flags", "is_rejected").agg(F.count("*").alias("rows"))


def pub_quality(spark, sf_dir):
    return payments.quality_report(flagged(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact documents as JSON text, one per supplier.

    A document holds a bounded number of facts: fourteen concepts, four filings per year.
    """
    rows = samples.mapped(spark, sf_dir, samples.FACT_ROWS)
    listed = rows.groupBy("l_suppkey", "concept").agg(
        F.array_sort(F.collect_list(F.struct("pos", "val", "filed", "end", "form"))).alias("facts")
    )
    units = F.struct(F.struct(F.transform("facts", lambda f: f.dropFields("pos")).alias("USD")).alias("units"))
    gaap = F.map_from_entries(F.collect_list(F.struct("concept", units.alias("c"))))
    key = F.col("l_suppkey")
    return listed.groupBy("l_suppkey").agg(gaap.alias("us-gaap")).select(
        "l_suppkey",
        F.to_json(
            F.struct(
                F.when(key % 9 != 4, key).alias("cik"),
                F.when(key % 4 != 2, F.concat(F.lit("Company "), key.cast("string"))).alias("entityName"),
                F.concat(F.lit("Alias "), key.cast("string")).alias("entity_name"),
                (key % 13).cast("string").alias("sic"),
                F.when(key % 5 != 3, F.concat(F.lit("Sector "), (key % 7).cast("string"))).alias("sicDescription"),
                F.struct("us-gaap").alias("facts"),
            )
        ).alias("value"),
    )


def sec_latest(spark, sf_dir):
    picked = facts.pick_facts(facts.parse_documents(documents(spark, sf_dir)))
    return facts.feature_rows(picked, "l_suppkey").filter(F.col("concept").isNotNull())


def profiles(spark, sf_dir):
    return facts.company_profiles(facts.parse_documents(documents(spark, sf_dir)), "l_suppkey")


def sec_profile(spark, sf_dir):
    return profiles(spark, sf_dir)


def sec_quality(spark, sf_dir):
    return facts.quality_summary(profiles(spark, sf_dir))


QUERIES = {
    "pub_clean": pub_clean,
    "pub_features": pub_features,
    "pub_labels": pub_labels,
    "pub_dupes": pub_dupes,
    "pub_flags": pub_flags,
    "pub_flagged_rows": pub_flagged_rows,
    "pub_ml_ready": pub_ml_ready,
    "pub_quality": pub_quality,
    "sec_latest": sec_latest,
    "sec_profile": sec_profile,
    "sec_quality": sec_quality,
}
