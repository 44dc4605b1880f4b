"""Public payment-practice reports: cleaning, company features, labels and quality issues."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import first_match
from ..functions.dates import iso_date
from ..functions.numbers import amount_digits, clamp, number_or_null, rounded
from ..functions.text import (
    company_name,
    company_number,
    known_or_null,
    mentions_any,
    strip,
    terms_changed_flag,
    yes_no_text,
)
from .common import settle, written

# Source header -> column name.
COLUMN_NAMES = {
    "Report Id": "report_id",
    "Policy Regime": "policy_regime",
    "Financial period start date": "financial_period_start_date",
    "Start date": "reporting_period_start",
    "End date": "reporting_period_end",
    "Filing date": "filing_date",
    "Company": "company_name",
    "Company number": "company_number",
    "Average time to pay": "avg_days_to_pay",
    "Total value invoices paid within 30 days": "value_paid_within_30",
    "Total value invoices paid between 31 and 60 days": "value_paid_31_60",
    "Total value invoices paid later than 60 days": "value_paid_later_60",
    "% Invoices paid within 30 days": "pct_paid_within_30",
    "% Invoices paid between 31 and 60 days": "pct_paid_31_60",
    "% Invoices paid later than 60 days": "pct_paid_later_60",
    "Total value invoices paid later than agreed terms": "value_paid_later_than_terms",
    "% Invoices not paid within agreed terms": "pct_not_paid_within_terms",
    "% Invoices not paid due to dispute": "pct_not_paid_due_to_dispute",
    "Shortest (or only) standard payment period": "shortest_standard_payment_period",
    "Longest standard payment period": "longest_standard_payment_period",
    "Standard payment terms": "standard_payment_terms",
    "Payment terms have changed": "payment_terms_have_changed",
    "Suppliers notified of changes": "suppliers_notified_of_changes",
    "Maximum contractual payment period": "maximum_contractual_payment_period",
    "Maximum contractual payment period information": "maximum_contractual_payment_period_info",
    "Other information payment terms": "other_payment_terms_info",
    "Participates in payment codes": "participates_in_payment_codes",
    "E-Invoicing offered": "e_invoicing_offered",
    "Supply-chain financing offered": "supply_chain_financing_offered",
    "URL": "source_url",
}
# Which columns are dates, numbers and yes/no texts.
DATES = (
    "financial_period_start_date",
    "reporting_period_start",
    "reporting_period_end",
    "filing_date",
)
NUMBERS = (
    "avg_days_to_pay",
    "pct_paid_within_30",
    "pct_paid_31_60",
    "pct_paid_later_60",
    "pct_not_paid_within_terms",
    "pct_not_paid_due_to_dispute",
    "value_paid_within_30",
    "value_paid_31_60",
    "value_paid_later_60",
    "value_paid_later_than_terms",
    "shortest_standard_payment_period",
    "longest_standard_payment_period",
    "maximum_contractual_payment_period",
)
YES_NO = (
    "suppliers_notified_of_changes",
    "participates_in_payment_codes",
    "e_invoicing_offered",
    "supply_chain_financing_offered",
)
# Words that mark why payment terms changed.
COVID_WORDS = ("covid", "coronavirus", "pandemic", "lockdown")
POLICY_WORDS = (
    "policy",
    "policies",
    "term",
    "terms",
    "contract",
    "contractual",
    "standard",
    "procedure",
    "process",
)
SUPPLIER_WORDS = ("supplier", "suppliers", "vendor", "vendors")
# The columns of the model-ready output, in order.
ML_READY_COLUMNS = [
    "original_row_index",
    "report_id",
    "policy_regime",
    "company_name",
    "company_number",
    "reporting_period_start",
    "reporting_period_end",
    "filing_date",
    "reporting_period",
    "reporting_period_length_days",
    "company_reporting_count",
    "avg_days_to_pay",
    "pct_paid_within_30",
    "pct_paid_31_60",
    "pct_paid_later_60",
    "pct_not_paid_within_terms",
    "pct_not_paid_due_to_dispute",
    "value_paid_within_30",
    "value_paid_31_60",
    "value_paid_later_60",
    "value_paid_later_than_terms",
    "reported_paid_invoice_value",
    "value_paid_later_than_60",
    "share_value_late_if_available",
    "shortest_standard_payment_period",
    "longest_standard_payment_period",
    "maximum_contractual_payment_period",
    "standard_payment_terms",
    "payment_terms_have_changed",
    "payment_terms_changed_flag",
    "payment_terms_changed_covid_related",
    "payment_terms_changed_policy_related",
    "payment_terms_changed_supplier_related",
    "suppliers_notified_of_changes",
    "e_invoicing_offered",
    "supply_chain_financing_offered",
    "participates_in_payment_codes",
    "has_value_bucket_data",
    "has_terms_data",
    "has_quality_flags",
    "quality_flags",
    "payment_speed_score",
    "payment_reliability_score",
    "payment_behavior_score",
    "public_payment_risk_band",
    "slow_payer_label",
    "late_terms_label",
    "source_url",
]
# Limits of the labels, bands and checks.
SLOW_DAYS, LATE_TERMS_PERCENT = 60, 25
MEDIUM_DAYS, MEDIUM_PERCENT = 30, 10
MAX_AVERAGE_DAYS = 365
BUCKET_SUM_LOW, BUCKET_SUM_HIGH = 99, 101
REQUIRED = (
    "company_name",
    "company_number",
    "reporting_period_start",
    "reporting_period_end",
    "avg_days_to_pay",
)
PERIOD_KEY = ("company_number", "reporting_period_start", "reporting_period_end")
BUCKET_PERCENTS = ("pct_paid_within_30", "pct_paid_31_60", "pct_paid_later_60")
PERCENTS = (*BUCKET_PERCENTS, "pct_not_paid_within_terms", "pct_not_paid_due_to_dispute")
BUCKET_VALUES = ("value_paid_within_30", "value_paid_31_60", "value_paid_later_60")
VALUES = (*BUCKET_VALUES, "value_paid_later_than_terms")
ISSUES = (
    "missing_required_fields",
    "invalid_percentages",
    "invalid_average_payment_days",
    "duplicate_company_periods",
    "value_bucket_issues",
    "inconsistent_payment_terms",
    "payment_bucket_sum_issues",
)


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Rename known headers (ignoring spaces around them); absent columns become NULL.

    Unknown columns are kept.
    """
    found = {name.strip(): name for name in raw.columns}
    known = [
        (F.col(f"`{found[header]}`") if header in found else F.lit(None).cast("string")).alias(name)
        for header, name in COLUMN_NAMES.items()
    ]
    extra = [F.col(f"`{raw_name}`").alias(name) for name, raw_name in found.items() if name not in COLUMN_NAMES]
    return raw.select(*known, *extra)


def clean_reports(reports: DataFrame) -> DataFrame:
    """Typed dates, numbers and flags, standard identities and terms-change features."""
    texts = [n for n, t in reports.dtypes if t == "string" and n not in NUMBERS]
    # Stripping, then recognizing missing words, then typing: each step reads finished columns.
    stripped = reports.withColumns({n: strip(n) for n in texts})
    known = stripped.withColumns(
        {**{n: known_or_null(n) for n in texts}, **{n: amount_digits(n) for n in NUMBERS}}
    )
    changed = "payment_terms_have_changed"
    typed = known.withColumns(
        {
            "company_name": company_name("company_name"),
            "company_number": company_number("company_number"),
            **{name: iso_date(name) for name in DATES},
            **{name: number_or_null(name) for name in NUMBERS},
            **{name: yes_no_text(name) for name in YES_NO},
            "payment_terms_changed_flag": terms_changed_flag(changed),
            "payment_terms_changed_covid_related": mentions_any(changed, COVID_WORDS),
            "payment_terms_changed_policy_related": mentions_any(changed, POLICY_WORDS),
            "payment_terms_changed_supplier_related": mentions_any(changed, SUPPLIER_WORDS),
        }
    )
    start, end = F.col("reporting_period_start"), F.col("reporting_period_end")
    have_buckets = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in BUCKET_VALUES])
    return typed.withColumns(
        {
            "reporting_period": F.concat(start.cast("string"), F.lit(" to "), end.cast("string")),
            "reporting_period_length_days": F.datediff(end, start),
            "has_value_bucket_data": have_buckets,
            "has_terms_data": F.col("standard_payment_terms").isNotNull(),
        }
    )


def _score(name: str) -> Column:
    return rounded(clamp(F.lit(100.0) - F.col(name), 0.0, 100.0), 2)


def payment_features(reports: DataFrame) -> DataFrame:
    """Values, shares, scores and the risk band of each report."""
    total, late = F.col("reported_paid_invoice_value"), F.col("late_payment_value")
    speed, reliable = F.col("payment_speed_score"), F.col("payment_reliability_score")
    days, percent = F.col("avg_days_to_pay"), F.col("pct_not_paid_within_terms")
    return (
        reports.withColumns(
            {
                "reported_paid_invoice_value": reduce(lambda a, b: a + b, [F.col(c) for c in BUCKET_VALUES]),
                "late_payment_value": F.col("value_paid_later_than_terms"),
                "value_paid_later_than_60": F.col("value_paid_later_60"),
                "payment_speed_score": _score("avg_days_to_pay"),
                "payment_reliability_score": _score("pct_not_paid_within_terms"),
            }
        )
        .withColumns(
            {
                "share_value_late_if_available": clamp(F.try_divide(late, total) * 100, 0.0, 100.0),
                "payment_behavior_score": F.coalesce(
                    rounded(speed * 0.5 + reliable * 0.5, 2), speed, reliable
                ),
                "public_payment_risk_band": first_match(
                    [
                        (days.isNull() & percent.isNull(), "Unknown"),
                        ((days > SLOW_DAYS) | (percent > LATE_TERMS_PERCENT), "High"),
                        ((days > MEDIUM_DAYS) | (percent > MEDIUM_PERCENT), "Medium"),
                    ],
                    "Low",
                ),
            }
        )
    )


def slow_payer_labels(reports: DataFrame) -> DataFrame:
    """Labels of slow payment and late terms; NULL where the source value is missing."""
    return reports.withColumns(
        {
            "slow_payer_label": (F.col("avg_days_to_pay") > SLOW_DAYS).cast("int"),
            "late_terms_label": (F.col("pct_not_paid_within_terms") > LATE_TERMS_PERCENT).cast("int"),
        }
    )


def company_counts(reports: DataFrame) -> DataFrame:
    """Add company_reporting_count and period_report_count to each report.

    Both counts come from one aggregate per company and period, which shrinks a company that
    files most rows before the shuffle. That aggregate is written first and joined back, so
    both sides of the joins are shuffled and adaptive execution splits the partition of a
    company that files most rows (a window, or a join to the aggregate as planned, would keep
    it in one task). Reports without a company number have no company count; their periods
    are counted with NULL equal to NULL.
    """
    if "company_number" not in reports.columns:
        return reports.withColumns(
            {"company_reporting_count": F.lit(1).cast("bigint"), "period_report_count": F.lit(1).cast("bigint")}
        )
    company = PERIOD_KEY[0]
    keys = settle(reports.select(*PERIOD_KEY), *PERIOD_KEY)
    by_period = written(keys.groupBy(*PERIOD_KEY).agg(F.count("*").alias("period_report_count")), "period-counts")
    by_company = by_period.groupBy(company).agg(
        F.sum("period_report_count").alias("company_reporting_count")
    )
    # Only periods filed more than once need to travel back to the rows.
    repeated = by_period.filter(F.col("period_report_count") > 1)
    r, p = reports.alias("r"), repeated.alias("p")
    same_period = reduce(
        lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in PERIOD_KEY]
    )
    return (
        r.join(p, same_period, "left")
        .select("r.*", F.coalesce("period_report_count", F.lit(1)).alias("period_report_count"))
        .join(by_company, company, "left")
        .select(*reports.columns, "company_reporting_count", "period_report_count")
    )


def build_features(cleaned: DataFrame) -> DataFrame:
    """Cleaned reports with features, counts and labels."""
    return company_counts(slow_payer_labels(payment_features(cleaned)))


def issue_masks(df: DataFrame) -> dict[str, Column]:
    """One condition per issue; checks whose columns are absent are false, NULL is false."""
    have = set(df.columns)

    def any_of(names, test) -> Column:
        return reduce(or_, [test(F.col(n)) for n in names if n in have], F.lit(False))

    def when_all(names, make) -> Column:
        return make() if have.issuperset(names) else F.lit(False)

    def bucket_sum() -> Column:
        total = reduce(lambda a, b: a + b, [F.col(c) for c in BUCKET_PERCENTS])
        return (total < BUCKET_SUM_LOW) | (total > BUCKET_SUM_HIGH)

    terms = ("shortest_standard_payment_period", "longest_standard_payment_period")
    masks = {
        "missing_required_fields": any_of(REQUIRED, lambda c: c.isNull()),
        "invalid_percentages": any_of(PERCENTS, lambda c: (c < 0) | (c > 100)),
        "invalid_average_payment_days": any_of(
            ["avg_days_to_pay"], lambda c: (c < 0) | (c > MAX_AVERAGE_DAYS)
        ),
        "duplicate_company_periods": when_all(
            ["period_report_count"], lambda: F.col("period_report_count") > 1
        ),
        "value_bucket_issues": any_of(VALUES, lambda c: c < 0),
        "inconsistent_payment_terms": when_all(terms, lambda: F.col(terms[0]) > F.col(terms[1])),
        "payment_bucket_sum_issues": when_all(BUCKET_PERCENTS, bucket_sum),
    }
    return {name: F.coalesce(mask, F.lit(False)) for name, mask in masks.items()}


def flag_issues(df: DataFrame) -> DataFrame:
    """Add is_rejected, quality_flags (issue names joined by ';') and has_quality_flags."""
    masks = issue_masks(df)
    no_days = F.col("avg_days_to_pay").isNull() if "avg_days_to_pay" in df.columns else F.lit(False)
    flagged = df.withColumns(
        {
            "is_rejected": masks["missing_required_fields"] | no_days,
            "quality_flags": F.concat_ws(";", *[F.when(masks[n], F.lit(n)) for n in ISSUES]),
        }
    ).withColumn("has_quality_flags", F.col("quality_flags") != "")
    # Filters on the flags must not repeat the parsing below them.
    return settle(flagged, "is_rejected", "quality_flags", "has_quality_flags")


def output_frames(flagged: DataFrame) -> dict[str, DataFrame]:
    """The three row outputs: cleaned, flagged and model-ready."""
    cleaned = flagged.filter(~F.col("is_rejected"))
    ready = [name for name in ML_READY_COLUMNS if name in flagged.columns]
    return {
        "cleaned": cleaned,
        "flagged_rows": flagged.filter(F.col("has_quality_flags") | F.col("is_rejected")),
        "ml_ready": cleaned.select(*ready),
    }


def quality_report(flagged: DataFrame) -> DataFrame:
    """Row and column counts, issue counts, output counts and nulls per column, in one pass.

    Rows are (section, metric, value).
    """
    masks = issue_masks(flagged)
    columns = [c for c in flagged.columns if c != "period_report_count"]
    kept, noted = ~F.col("is_rejected"), F.col("has_quality_flags") | F.col("is_rejected")
    sections = {
        "size": {"row_count": F.count("*"), "column_count": F.first(F.lit(len(columns)))},
        "issue_counts": {
            **{n: F.count_if(masks[n]) for n in ISSUES},
            "rejected_rows": F.count_if(F.col("is_rejected")),
        },
        "output_counts": {
            "cleaned_rows": F.count_if(kept),
            "flagged_rows": F.count_if(noted),
            "ml_ready_rows": F.count_if(kept),
            "rejected_rows": F.count_if(~kept),
        },
        "missingness": {c: F.count_if(F.col(c).isNull()) for c in columns},
    }
    named = [
        (section, name, f"{section}.{name}", value)
        for section, metrics in sections.items()
        for name, value in metrics.items()
    ]
    row = flagged.agg(*[value.alias(key) for _, _, key, value in named])
    entries = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("metric"),
            F.coalesce(F.col(f"`{key}`"), F.lit(len(columns))).cast("bigint").alias("value"),
        )
        for section, name, key, _ in named
    ]
    return row.select(F.inline(F.array(*entries)))

