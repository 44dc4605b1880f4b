"""Company financial facts: latest usable value per feature, ratios, risk band, quality.

A document's facts live in one row, so the latest fact of every concept is picked with array
functions inside the row. The job reads, picks and writes without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import first_match
from ..functions.dates import iso_date
from ..functions.numbers import number_or_null, ratio
from ..functions.text import registry_key
from .common import settle, unpivot_metrics

# The concepts of each feature, in order of preference, and the accepted forms.
CONCEPTS = {
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"),
    "cash": (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ),
    "assets_current": ("AssetsCurrent",),
    "liabilities_current": ("LiabilitiesCurrent",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
    "accounts_payable": ("AccountsPayableCurrent", "AccountsPayableAndAccruedLiabilitiesCurrent"),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
}
FORMS = ("10-K", "10-Q", "20-F", "40-F")
UNIT = "USD"
PROFILE_COLUMNS = [
    "cik",
    "entity_name",
    "sic",
    "sic_description",
    "latest_filed_date",
    "latest_fiscal_period_end",
    "revenue",
    "cash",
    "assets_current",
    "liabilities_current",
    "assets",
    "liabilities",
    "equity",
    "accounts_payable",
    "operating_income",
    "net_income",
    "current_ratio",
    "cash_to_current_liabilities",
    "liabilities_to_assets",
    "accounts_payable_to_revenue",
    "net_margin",
    "sec_financial_risk_band",
]
CORE_FIELDS = (
    "revenue",
    "cash",
    "assets_current",
    "liabilities_current",
    "assets",
    "liabilities",
    "net_income",
)
RATIO_FIELDS = (
    "current_ratio",
    "cash_to_current_liabilities",
    "liabilities_to_assets",
    "accounts_payable_to_revenue",
    "net_margin",
)
RATIOS = {
    "current_ratio": ("assets_current", "liabilities_current"),
    "cash_to_current_liabilities": ("cash", "liabilities_current"),
    "liabilities_to_assets": ("liabilities", "assets"),
    "accounts_payable_to_revenue": ("accounts_payable", "revenue"),
    "net_margin": ("net_income", "revenue"),
}
EXTREME_CURRENT_RATIO, EXTREME_NET_MARGIN = 20, 5
TOP_SIC = 10
FIRST_DAY = "0001-01-01"
UNREADABLE = "unreadable"

_FACT = T.StructType([T.StructField(n, T.StringType()) for n in ("val", "filed", "end", "form")])
_UNITS = T.StructType([T.StructField(UNIT, T.ArrayType(_FACT))])
_CONCEPT = T.StructType([T.StructField("units", _UNITS)])
# Only the concepts in use are named, so the parser skips the thousands of others.
DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("cik", "entityName", "entity_name", "sic", "sicDescription")]
    + [
        T.StructField(
            "facts",
            T.StructType(
                [
                    T.StructField(
                        "us-gaap",
                        T.StructType(
                            [T.StructField(c, _CONCEPT) for names in CONCEPTS.values() for c in names]
                        ),
                    )
                ]
            ),
        )
    ]
)


def parse_documents(texts: DataFrame, text: str = "value") -> DataFrame:
    """Document texts as ``document`` structs, next to the other columns.

    A text that is not a JSON object is kept in ``document.unreadable``.
    """
    schema = T.StructType([*DOCUMENT.fields, T.StructField(UNREADABLE, T.StringType())])
    nothing = F.from_json(F.lit("{}"), schema)  # blank and null texts parse to NULL
    parsed = F.coalesce(F.from_json(F.col(text), schema, {"columnNameOfCorruptRecord": UNREADABLE}), nothing)
    empty = F.coalesce(F.trim(text) == "", F.lit(True))
    unreadable = F.when(empty, F.coalesce(text, F.lit(""))).otherwise(parsed[UNREADABLE])
    return texts.withColumn("document", parsed.withField(UNREADABLE, unreadable)).drop(text)


def unreadable_documents(documents: DataFrame) -> DataFrame:
    """Documents that could not be parsed, with ``problems``; the others make profiles."""
    bad = documents.filter(F.col(f"document.{UNREADABLE}").isNotNull())
    return bad.withColumn("problems", F.array(F.lit("Document is not a JSON object")))


def _day_or_first(text: Column) -> Column:
    """A strict date; missing or unreadable texts sort before every real date."""
    return F.coalesce(iso_date(text), F.lit(FIRST_DAY).cast("date"))


def _filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def concept_facts(concept: str) -> Column:
    """The USD facts of one concept; NULL when the document has none."""
    return F.col("document.facts").getField("us-gaap").getField(concept).getField("units").getField(UNIT)


def latest_fact(facts: Column, concept: str) -> Column:
    """The usable fact filed last, then with the latest period end, then listed first.

    Usable facts have an accepted form, a numeric value and a filing or end date.
    """

    def usable(fact: Column) -> Column:
        return (
            fact["form"].isin(*FORMS)
            & number_or_null(fact["val"]).isNotNull()
            & (_filled(fact["filed"]) | _filled(fact["end"]))
        )

    def ranked(fact: Column, place: Column) -> Column:
        return F.struct(
            _day_or_first(fact["filed"]).alias("filed_on"),
            _day_or_first(fact["end"]).alias("ended_on"),
            (-place).alias("order"),
            F.lit(concept).alias("concept"),
            number_or_null(fact["val"]).alias("value"),
            fact["filed"].alias("filed"),
            fact["end"].alias("end"),
            fact["form"].alias("form"),
        )

    return F.array_max(F.transform(F.filter(facts, usable), ranked))


def pick_facts(documents: DataFrame) -> DataFrame:
    """Add one struct column per feature: the latest fact of its first concept with any."""
    picks = {
        feature: F.coalesce(*[latest_fact(concept_facts(c), c) for c in names])
        for feature, names in CONCEPTS.items()
    }
    return settle(documents.withColumns(picks), *picks)


def feature_rows(picked: DataFrame, key: str) -> DataFrame:
    """The picked facts in long form: one row per document and feature."""
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"{f}.concept").alias("concept"),
            F.col(f"{f}.value").alias("value"),
            F.col(f"{f}.filed").alias("filed"),
            F.col(f"{f}.end").alias("period_end"),
            F.col(f"{f}.form").alias("form"),
        )
        for f in CONCEPTS
    ]
    return picked.select(key, F.inline(F.array(*rows)))


def _latest_text(name: str, day: str) -> Column:
    """The latest non-empty date text over all features; the first feature wins ties."""
    entries = [
        F.when(
            _filled(F.col(f"{feature}.{name}")),
            F.struct(F.col(f"{feature}.{day}").alias("day"), F.lit(-place).alias("order"),
                     F.col(f"{feature}.{name}").alias("text")),
        )
        for place, feature in enumerate(CONCEPTS)
    ]
    return F.array_max(F.array_compact(F.array(*entries)))["text"]


def _signals(tests: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Numbers of high signals and of medium signals; a high one is not also medium."""
    high = [F.when(h, 1).otherwise(0) for h, _ in tests]
    medium = [F.when(h, 0).when(m, 1).otherwise(0) for h, m in tests]
    return reduce(lambda a, b: a + b, high), reduce(lambda a, b: a + b, medium)


def risk_band() -> Column:
    """High / Medium / Low / Unknown from the four judged ratios."""
    current, cash = F.col("current_ratio"), F.col("cash_to_current_liabilities")
    debt, margin = F.col("liabilities_to_assets"), F.col("net_margin")
    high, medium = _signals(
        [
            (current < 1, current < 1.5),
            (cash < 0.1, cash < 0.25),
            (debt > 0.9, debt > 0.7),
            (margin < -0.1, margin < 0),
        ]
    )
    unknown = current.isNull() & cash.isNull() & debt.isNull() & margin.isNull()
    return first_match(
        [(high >= 2, "High"), ((high == 1) | (medium >= 2), "Medium"), (medium == 1, "Low"), (unknown, "Unknown")],
        "Low",
    )


def company_profiles(documents: DataFrame, *keep: str) -> DataFrame:
    """One profile per readable document, also for documents without any fact.

    ``keep`` names further input columns to carry along.
    """
    picked = pick_facts(documents.filter(F.col(f"document.{UNREADABLE}").isNull()))
    doc = F.col("document")
    name = F.coalesce(F.nullif(doc["entityName"], F.lit("")), doc["entity_name"])
    base = picked.select(
        *keep,
        registry_key(doc["cik"]).alias("cik"),
        name.alias("entity_name"),
        doc["sic"].alias("sic"),
        doc["sicDescription"].alias("sic_description"),
        _latest_text("filed", "filed_on").alias("latest_filed_date"),
        _latest_text("end", "ended_on").alias("latest_fiscal_period_end"),
        *[F.col(f"{f}.value").alias(f) for f in CONCEPTS],
    )
    ratios = {r: ratio(F.col(top), F.col(bottom)) for r, (top, bottom) in RATIOS.items()}
    return (
        base.withColumns(ratios)
        .withColumn("sec_financial_risk_band", risk_band())
        .select(*keep, *PROFILE_COLUMNS)
    )


def value_counts(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; NULL is shown as Missing."""
    counts = (
        df.groupBy(F.coalesce(F.col(name).cast("string"), F.lit("Missing")).alias("value"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "value")
    )
    return counts if limit is None else counts.limit(limit)


def profile_quality(profiles: DataFrame) -> DataFrame:
    """The quality counts as (metric, value); a count over absent columns is NULL."""
    have = set(profiles.columns)

    def number(name: str) -> Column:
        c = F.col(name)
        return number_or_null(c) if dict(profiles.dtypes)[name] == "string" else c.cast("double")

    def missing(name: str) -> Column:
        return F.count_if(F.col(name).isNull()) if name in have else F.lit(None)

    def all_missing(names) -> Column:
        present = [F.col(n).isNull() for n in names if n in have]
        return F.count_if(reduce(lambda a, b: a & b, present)) if present else F.lit(None)

    def count(name: str, test) -> Column:
        return F.count_if(test(number(name))) if name in have else F.lit(None)

    metrics = {
        "total_companies": F.count("*"),
        "unique_ciks": F.count_distinct("cik") if "cik" in have else F.lit(None),
        "missing_entity_name": missing("entity_name"),
        "missing_latest_filed_date": missing("latest_filed_date"),
        "missing_latest_fiscal_period_end": missing("latest_fiscal_period_end"),
        **{f"missing_core.{n}": missing(n) for n in CORE_FIELDS if n in have},
        **{f"missing_ratio.{n}": missing(n) for n in RATIO_FIELDS if n in have},
        "companies_with_no_core_financials": all_missing(CORE_FIELDS),
        "companies_with_no_ratios": all_missing(RATIO_FIELDS),
        "negative_revenue_count": count("revenue", lambda c: c < 0),
        "negative_equity_count": count("equity", lambda c: c < 0),
        "extreme_current_ratio_count": count("current_ratio", lambda c: c > EXTREME_CURRENT_RATIO),
        "extreme_net_margin_count": count("net_margin", lambda c: F.abs(c) > EXTREME_NET_MARGIN),
    }
    keys = {name: name.replace(".", "__") for name in metrics}
    row = profiles.agg(*[value.alias(keys[name]) for name, value in metrics.items()])
    counts = unpivot_metrics(row, list(keys.values())).withColumn(
        "metric", F.replace("metric", F.lit("__"), F.lit("."))
    )
    return counts


def quality_summary(profiles: DataFrame) -> DataFrame:
    """Quality counts, band distribution and top SIC descriptions as (section, metric, value)."""

    def section(name: str, df: DataFrame) -> DataFrame:
        return df.toDF("metric", "value").select(F.lit(name).alias("section"), "metric", "value")

    parts = [section("counts", profile_quality(profiles))]
    if "sec_financial_risk_band" in profiles.columns:
        parts.append(section("risk_band_distribution", value_counts(profiles, "sec_financial_risk_band")))
    if "sic_description" in profiles.columns:
        parts.append(section("top_sic_descriptions", value_counts(profiles, "sic_description", TOP_SIC)))
    return reduce(DataFrame.unionByName, parts)
