"""DuckDB SQL for the payment-report and company-fact queries."""

from __future__ import annotations

from ledgermill.operators.payments import ISSUES, ML_READY_COLUMNS
from ledgermill.sources import sample_tables as samples


def _known(c):
    text = f"trim({c})"
    return f"case when lower({text}) not in ('', 'none', 'null', 'nan', 'n/a') then {text} end"


def _name(c):
    return f"upper(regexp_replace(trim({c}), '\\s+', ' ', 'g'))"


def _number(c):
    text = f"replace(replace(replace({c}, ',', ''), '£', ''), '%', '')"
    return rf"try_cast(regexp_replace({text}, '^\((.*)\)$', '-\1') as double)"


def _yes_no(c):
    return (f"case when lower({c}) in ('true', 'yes', 'y', '1') then 'True'"
            f" when lower({c}) in ('false', 'no', 'n', '0') then 'False' else {c} end")


def _mentions(c, words):
    tests = " or ".join(f"contains(lower({c}), '{w}')" for w in words)
    return f"cast(coalesce({tests}, false) as integer)"


_TEXTS = {
    "report_id": "Report Id", "policy_regime": "Policy Regime",
    "standard_payment_terms": "Standard payment terms", "payment_terms_have_changed": "Payment terms have changed",
    "maximum_contractual_payment_period_info": "Maximum contractual payment period information",
    "other_payment_terms_info": "Other information payment terms", "source_url": "URL",
}
_DATES = {
    "financial_period_start_date": "Financial period start date", "reporting_period_start": "Start date",
    "reporting_period_end": "End date", "filing_date": "Filing date",
}
_NUMBERS = {
    "avg_days_to_pay": "Average time to pay",
    "value_paid_within_30": "Total value invoices paid within 30 days",
    "value_paid_31_60": "Total value invoices paid between 31 and 60 days",
    "value_paid_later_60": "Total value invoices paid later than 60 days",
    "pct_paid_within_30": "% Invoices paid within 30 days",
    "pct_paid_31_60": "% Invoices paid between 31 and 60 days",
    "pct_paid_later_60": "% Invoices paid later than 60 days",
    "value_paid_later_than_terms": "Total value invoices paid later than agreed terms",
    "pct_not_paid_within_terms": "% Invoices not paid within agreed terms",
    "pct_not_paid_due_to_dispute": "% Invoices not paid due to dispute",
    "shortest_standard_payment_period": "Shortest (or only) standard payment period",
    "longest_standard_payment_period": "Longest standard payment period",
    "maximum_contractual_payment_period": "Maximum contractual payment period",
}
_FLAGS = {
    "suppliers_notified_of_changes": "Suppliers notified of changes",
    "participates_in_payment_codes": "Participates in payment codes",
    "e_invoicing_offered": "E-Invoicing offered",
    "supply_chain_financing_offered": "Supply-chain financing offered",
}
_ID = {"company_name": "Company", "company_number": "Company number"}
_ALL = {**_TEXTS, **_DATES, **_NUMBERS, **_FLAGS, **_ID}
_CHANGED = "payment_terms_have_changed"

TABLES = {
    "raw": samples.duckdb_text(samples.PAYMENT_REPORTS),
    "known": "select " + ", ".join(f'{_known(chr(34) + raw + chr(34))} as {n}' for n, raw in _ALL.items()) + " from raw",
    "typed": "select " + ", ".join(
        [*_TEXTS]
        + [f"cast(try_strptime({n}, '%Y-%m-%d') as date) as {n}" for n in _DATES]
        + [f"{_number(n)} as {n}" for n in _NUMBERS]
        + [f"{_yes_no(n)} as {n}" for n in _FLAGS]
        + [
            f"{_name('company_name')} as company_name",
            "case when regexp_matches(company_number, '^[0-9]{1,7}$') then lpad(company_number, 8, '0')"
            " else upper(company_number) end as company_number",
            f"case when {_CHANGED} is null then 'Unknown'"
            f" when lower({_CHANGED}) in ('true', 'yes', 'y', '1') then 'Yes'"
            f" when lower({_CHANGED}) in ('false', 'no', 'n', '0') then 'No'"
            f" when lower({_CHANGED}) like '%no change%' or lower({_CHANGED}) like '%not changed%' then 'No'"
            " else 'Yes' end as payment_terms_changed_flag",
            f"{_mentions(_CHANGED, ['covid', 'coronavirus', 'pandemic', 'lockdown'])}"
            " as payment_terms_changed_covid_related",
            f"{_mentions(_CHANGED, ['policy', 'policies', 'term', 'contract', 'standard', 'procedure', 'process'])}"
            " as payment_terms_changed_policy_related",
            f"{_mentions(_CHANGED, ['supplier', 'vendor'])} as payment_terms_changed_supplier_related",
        ]
    ) + " from known",
    "cleaned": """
select *, cast(reporting_period_start as varchar) || ' to ' || cast(reporting_period_end as varchar) as reporting_period,
  cast(datediff('day', reporting_period_start, reporting_period_end) as integer) as reporting_period_length_days,
  value_paid_within_30 is not null and value_paid_31_60 is not null and value_paid_later_60 is not null
    as has_value_bucket_data,
  standard_payment_terms is not null as has_terms_data
from typed""",
    "features": """
select *, case when reported_paid_invoice_value <> 0 and late_payment_value is not null
    then least(greatest(late_payment_value / reported_paid_invoice_value * 100, 0), 100) end
    as share_value_late_if_available,
  case when payment_speed_score is null then payment_reliability_score
    when payment_reliability_score is null then payment_speed_score
    else cast(printf('%.2f', payment_speed_score * 0.5::double + payment_reliability_score * 0.5::double) as double) end
    as payment_behavior_score
from (
  select *, value_paid_within_30 + value_paid_31_60 + value_paid_later_60 as reported_paid_invoice_value,
    value_paid_later_than_terms as late_payment_value, value_paid_later_60 as value_paid_later_than_60,
    case when avg_days_to_pay is not null
      then cast(printf('%.2f', least(greatest(100 - avg_days_to_pay, 0), 100)) as double) end as payment_speed_score,
    case when pct_not_paid_within_terms is not null
      then cast(printf('%.2f', least(greatest(100 - pct_not_paid_within_terms, 0), 100)) as double) end
      as payment_reliability_score,
    case when avg_days_to_pay is null and pct_not_paid_within_terms is null then 'Unknown'
      when avg_days_to_pay > 60 or pct_not_paid_within_terms > 25 then 'High'
      when avg_days_to_pay > 30 or pct_not_paid_within_terms > 10 then 'Medium' else 'Low' end
      as public_payment_risk_band,
    cast(avg_days_to_pay > 60 as integer) as slow_payer_label,
    cast(pct_not_paid_within_terms > 25 as integer) as late_terms_label,
    case when company_number is not null then count(*) over (partition by company_number) end
      as company_reporting_count,
    count(*) over (partition by company_number, reporting_period_start, reporting_period_end) as period_report_count
  from cleaned) as c""",
    "checked": """
select *,
  company_name is null or company_number is null or reporting_period_start is null or reporting_period_end is null
    or avg_days_to_pay is null as missing_required_fields,
  coalesce(pct_paid_within_30 not between 0 and 100, false) or coalesce(pct_paid_31_60 not between 0 and 100, false)
    or coalesce(pct_paid_later_60 not between 0 and 100, false)
    or coalesce(pct_not_paid_within_terms not between 0 and 100, false)
    or coalesce(pct_not_paid_due_to_dispute not between 0 and 100, false) as invalid_percentages,
  coalesce(avg_days_to_pay not between 0 and 365, false) as invalid_average_payment_days,
  period_report_count > 1 as duplicate_company_periods,
  coalesce(value_paid_within_30 < 0, false) or coalesce(value_paid_31_60 < 0, false)
    or coalesce(value_paid_later_60 < 0, false) or coalesce(value_paid_later_than_terms < 0, false)
    as value_bucket_issues,
  coalesce(shortest_standard_payment_period > longest_standard_payment_period, false) as inconsistent_payment_terms,
  coalesce(pct_paid_within_30 + pct_paid_31_60 + pct_paid_later_60 not between 99 and 101, false)
    as payment_bucket_sum_issues
from features""",
    "flagged": "select *, missing_required_fields as is_rejected, quality_flags <> '' as has_quality_flags from ("
    "select *, concat_ws(';', " + ", ".join(f"case when {n} then '{n}' end" for n in ISSUES)
    + ") as quality_flags from checked) as f",
}
_WITH = "with " + ",\n".join(f"{n} as ({t})" for n, t in TABLES.items()) + "\n"
_READY = ", ".join(c for c in ML_READY_COLUMNS if c != "original_row_index")
_REPORT_COLUMNS = [
    *_ALL, "payment_terms_changed_flag", "payment_terms_changed_covid_related",
    "payment_terms_changed_policy_related", "payment_terms_changed_supplier_related", "reporting_period",
    "reporting_period_length_days", "has_value_bucket_data", "has_terms_data", "reported_paid_invoice_value",
    "late_payment_value", "value_paid_later_than_60", "share_value_late_if_available", "payment_speed_score",
    "payment_reliability_score", "payment_behavior_score", "public_payment_risk_band", "slow_payer_label",
    "late_terms_label", "company_reporting_count", "is_rejected", "quality_flags", "has_quality_flags",
]


def _metric(section, name, value):
    return f"select '{section}' as section, '{name}' as metric, {value} as value from flagged"


_QUALITY = "\nunion all ".join(
    [_metric("size", "row_count", "count(*)"),
     _metric("size", "column_count", f"any_value({len(_REPORT_COLUMNS)})::bigint")]
    + [_metric("issue_counts", n, f"count(*) filter ({n})") for n in ISSUES]
    + [_metric("issue_counts", "rejected_rows", "count(*) filter (is_rejected)"),
       _metric("output_counts", "cleaned_rows", "count(*) filter (not is_rejected)"),
       _metric("output_counts", "flagged_rows", "count(*) filter (has_quality_flags or is_rejected)"),
       _metric("output_counts", "ml_ready_rows", "count(*) filter (not is_rejected)"),
       _metric("output_counts", "rejected_rows", "count(*) filter (is_rejected)")]
    + [_metric("missingness", c, f"count(*) filter ({c} is null)") for c in _REPORT_COLUMNS]
)

_CONCEPTS = [
    ("revenue", "Revenues", 0), ("revenue", "SalesRevenueNet", 2),
    ("cash", "CashAndCashEquivalentsAtCarryingValue", 0),
    ("cash", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", 1),
    ("assets_current", "AssetsCurrent", 0), ("liabilities_current", "LiabilitiesCurrent", 0), ("assets", "Assets", 0),
    ("liabilities", "Liabilities", 0), ("equity", "StockholdersEquity", 0),
    ("accounts_payable", "AccountsPayableCurrent", 0), ("operating_income", "OperatingIncomeLoss", 0),
    ("net_income", "NetIncomeLoss", 0), ("net_income", "ProfitLoss", 1),
]
_FEATURES = list(dict.fromkeys(f for f, _, _ in _CONCEPTS))


def _ratio(a, b):
    return f"case when {a} is not null and {b} <> 0 then cast(printf('%.6f', {a} / {b}) as double) end"


FACTS = {
    "facts": samples.duckdb_text(samples.FACT_ROWS),
    "usable": """
select f.*, m.feature, m.priority, m.place, try_cast(val as double) as value,
  coalesce(cast(try_strptime(filed, '%Y-%m-%d') as date), date '0001-01-01') as filed_on,
  coalesce(cast(try_strptime("end", '%Y-%m-%d') as date), date '0001-01-01') as ended_on
from facts as f join (values """ + ", ".join(
        f"('{f}', '{c}', {p}, {_FEATURES.index(f)})" for f, c, p in _CONCEPTS
    ) + """) as m(feature, concept, priority, place) on f.concept = m.concept
where form in ('10-K', '10-Q', '20-F', '40-F') and try_cast(val as double) is not null
  and (filed <> '' or "end" <> '')""",
    "picked": """
select * from usable qualify row_number() over (
  partition by l_suppkey, feature order by priority, filed_on desc, ended_on desc, pos) = 1""",
    "wide": "select s.l_suppkey, " + ", ".join(
        f"max(value) filter (feature = '{f}') as {f}" for f in _FEATURES
    ) + """,
  arg_max(nullif(filed, ''), (filed_on, -place)) filter (filed <> '') as latest_filed_date,
  arg_max(nullif("end", ''), (ended_on, -place)) filter ("end" <> '') as latest_fiscal_period_end
from (select distinct l_suppkey from facts) as s left join picked as p on s.l_suppkey = p.l_suppkey
group by s.l_suppkey""",
    "ratios": f"""
select *, {_ratio('assets_current', 'liabilities_current')} as current_ratio,
  {_ratio('cash', 'liabilities_current')} as cash_to_current_liabilities,
  {_ratio('liabilities', 'assets')} as liabilities_to_assets,
  {_ratio('accounts_payable', 'revenue')} as accounts_payable_to_revenue,
  {_ratio('net_income', 'revenue')} as net_margin
from wide""",
    "profile": """
select * exclude (high, medium), case when high >= 2 then 'High' when high = 1 or medium >= 2 then 'Medium'
    when medium = 1 then 'Low'
    when current_ratio is null and cash_to_current_liabilities is null and liabilities_to_assets is null
      and net_margin is null then 'Unknown' else 'Low' end as sec_financial_risk_band,
  case when l_suppkey % 9 <> 4 then lpad(cast(l_suppkey as varchar), 10, '0') end as cik,
  case when l_suppkey % 4 <> 2 then 'Company ' else 'Alias ' end || l_suppkey as entity_name,
  cast(l_suppkey % 13 as varchar) as sic,
  case when l_suppkey % 5 <> 3 then 'Sector ' || (l_suppkey % 7) end as sic_description
from (
  select *,
    (coalesce(current_ratio < 1, false)::int + coalesce(cash_to_current_liabilities < 0.1, false)::int
      + coalesce(liabilities_to_assets > 0.9, false)::int + coalesce(net_margin < -0.1, false)::int) as high,
    (coalesce(current_ratio >= 1 and current_ratio < 1.5, false)::int
      + coalesce(cash_to_current_liabilities >= 0.1 and cash_to_current_liabilities < 0.25, false)::int
      + coalesce(liabilities_to_assets <= 0.9 and liabilities_to_assets > 0.7, false)::int
      + coalesce(net_margin >= -0.1 and net_margin < 0, false)::int) as medium
  from ratios) as r""",
}
_FACTS = "with " + ",\n".join(f"{n} as ({t})" for n, t in FACTS.items()) + "\n"


def _count(name, test):
    return f"select 'counts' as section, '{name}' as metric, count(*) filter ({test}) as value from profile"


_CORE = ["revenue", "cash", "assets_current", "liabilities_current", "assets", "liabilities", "net_income"]
_RATIOS = ["current_ratio", "cash_to_current_liabilities", "liabilities_to_assets", "accounts_payable_to_revenue",
           "net_margin"]
_SEC_QUALITY = "\nunion all ".join(
    [_count("total_companies", "true"),
     "select 'counts', 'unique_ciks', count(distinct cik) from profile",
     _count("missing_entity_name", "entity_name is null"),
     _count("missing_latest_filed_date", "latest_filed_date is null"),
     _count("missing_latest_fiscal_period_end", "latest_fiscal_period_end is null")]
    + [_count(f"missing_core.{c}", f"{c} is null") for c in _CORE]
    + [_count(f"missing_ratio.{c}", f"{c} is null") for c in _RATIOS]
    + [_count("companies_with_no_core_financials", " and ".join(f"{c} is null" for c in _CORE)),
       _count("companies_with_no_ratios", " and ".join(f"{c} is null" for c in _RATIOS)),
       _count("negative_revenue_count", "revenue < 0"), _count("negative_equity_count", "equity < 0"),
       _count("extreme_current_ratio_count", "current_ratio > 20"),
       _count("extreme_net_margin_count", "abs(net_margin) > 5"),
       "select 'risk_band_distribution', sec_financial_risk_band, count(*) from profile group by 2",
       "select * from (select 'top_sic_descriptions', coalesce(sic_description, 'Missing') as v, count(*) as n"
       " from profile group by 2 order by n desc, v limit 10)"]
)

ORACLES = {
    "pub_clean": _WITH + f"select {', '.join(_REPORT_COLUMNS[:len(_ALL) + 8])} from cleaned",
    "pub_features": _WITH + """
select report_id, reported_paid_invoice_value, late_payment_value, value_paid_later_than_60,
  share_value_late_if_available, payment_speed_score, payment_reliability_score, payment_behavior_score,
  public_payment_risk_band from features""",
    "pub_labels": _WITH + """
select report_id, avg_days_to_pay, pct_not_paid_within_terms, slow_payer_label, late_terms_label from features""",
    "pub_dupes": _WITH + "select report_id, company_number, company_reporting_count, period_report_count from features",
    "pub_flags": _WITH + "select report_id, is_rejected, has_quality_flags, quality_flags from flagged",
    "pub_flagged_rows": _WITH + """
select quality_flags, is_rejected, count(*) as rows from flagged where has_quality_flags or is_rejected group by all""",
    "pub_ml_ready": _WITH + f"select {_READY} from flagged where not is_rejected",
    "pub_quality": _WITH + _QUALITY,
    "sec_latest": _FACTS + 'select l_suppkey, feature, concept, value, filed, "end" as period_end, form from picked',
    "sec_profile": _FACTS + "select * from profile",
    "sec_quality": _FACTS + _SEC_QUALITY,
}
