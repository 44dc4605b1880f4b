"""Job inputs derived from a star-schema sample (orders, lineitem) for queries and benchmarks.

Each mapping is a SQL text that Spark and DuckDB both accept, so a check can run the same
input through both engines. ``{orders}`` and ``{lineitem}`` stand for the source tables;
``{each a, b}`` repeats a row once per listed value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

# One row per order with a posting date, payment term, days to payment and open flag. Orders
# of status O in the last 240 days are unpaid.
_ORDER_BASE = """
select o_orderkey, o_custkey, o_totalprice, posting_date, term, pay_days,
       case when o_orderstatus = 'O' and posting_date > last_date - 240 then 1 else 0 end as is_open
from (
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
         cast(o_orderdate as date) as posting_date,
         (select max(cast(o_orderdate as date)) from {orders}) as last_date,
         case substr(o_orderpriority, 1, 1)
           when '1' then 10 when '2' then 20 when '3' then 30 when '4' then 45 else 60
         end as term,
         cast((o_orderkey * 37 + o_custkey * 11) % 70 as int) as pay_days
  from {orders}
) as o
"""

_CUSTOMER_NAME = """
         case when o_orderkey % 13 = 0 then null
              when o_orderkey % 11 = 0 then 'Customer ' || cast(o_custkey as string) || ' Ltd'
              else 'Customer ' || cast(o_custkey as string) end"""

INVOICES = f"""
select cast(o_orderkey as string) as invoice_id,
       cast(o_orderkey + 1000000 as string) as doc_id,
       'C' || cast(o_custkey as string) as customer_id,
       {_CUSTOMER_NAME} as customer_name,
       case when o_orderkey % 3 = 0 then 'U001' else 'CA02' end as business_code,
       cast(year(posting_date) as int) as business_year,
       posting_date,
       posting_date + term as due_date,
       case when is_open = 0 then posting_date + pay_days end as clear_date,
       case when o_orderkey % 10 = 7 then 'CAD' else 'USD' end as currency,
       'NA' || cast(term as string) as payment_terms,
       cast(o_totalprice as decimal(18,2)) as invoice_amount,
       is_open,
       case when is_open = 1 then 'Unknown' when pay_days > term then 'Late' else 'On Time' end
         as late_payment_status,
       case when is_open = 0 then pay_days - term end as payment_delay_days
from ({_ORDER_BASE}) as b
"""

# The same invoices as raw text with injected faults, one kind per remainder of the key, and
# some exact duplicates.
RAW_INVOICES = f"""
select business_code, customer_id_raw, customer_name_raw, clear_date_raw, business_year_raw,
       doc_id_raw, posting_date_raw, document_create_date_raw, document_create_date_1_raw,
       due_date_raw, invoice_currency_raw, document_type_raw, posting_id_raw, area_business_raw,
       invoice_amount_raw, baseline_create_date_raw, payment_terms_raw, invoice_id_raw, is_open_raw
from (
  select case when o_orderkey % 3 = 0 then ' U001' else 'CA02 ' end as business_code,
         case when k = 2 then '  ' else 'C' || cast(o_custkey as string) end as customer_id_raw,
         '  ' || {_CUSTOMER_NAME} || ' ' as customer_name_raw,
         case when k = 7 then '' when k = 8 then cast(posting_date as string)
              when k = 9 then cast(posting_date - 1 as string)
              when k = 16 and is_open = 0 then '2001-11-31 00:00:00'
              when is_open = 1 then ' '
              else cast(posting_date + pay_days as string) || ' 00:00:00' end as clear_date_raw,
         cast(year(posting_date) as string) || '.0' as business_year_raw,
         case when k = 15 then '' else cast(o_orderkey + 1000000 as string) || '.0' end as doc_id_raw,
         case when k = 3 then 'unknown' else cast(posting_date as string) end as posting_date_raw,
         replace(cast(posting_date as string), '-', '') as document_create_date_raw,
         replace(cast(posting_date + 1 as string), '-', '') || '.0' as document_create_date_1_raw,
         case when k = 4 then '20001301' when k = 12 then '20010230.0'
              else replace(cast(posting_date + term as string), '-', '') || '.0' end as due_date_raw,
         case when o_orderkey % 10 = 7 then 'CAD' else 'USD' end as invoice_currency_raw,
         'RV' as document_type_raw,
         '1.0' as posting_id_raw,
         '' as area_business_raw,
         case when k = 5 then '-5.00' when k = 13 then 'x' when k = 14 then '12abc'
              else cast(cast(o_totalprice as decimal(18,2)) as string) end as invoice_amount_raw,
         replace(cast(posting_date as string), '-', '') || '.0' as baseline_create_date_raw,
         'NA' || cast(term as string) as payment_terms_raw,
         case when k = 1 then '' else cast(o_orderkey as string) || '.0' end as invoice_id_raw,
         case when k = 6 then '2' when k = 7 then '0' when k = 8 then '1'
              when k = 10 then '' when k = 11 then 'abc' else cast(is_open as string) end as is_open_raw,
         copy, copies
  from (select *, o_orderkey % 29 as k, {{each 1, 2}} as copy,
               case when o_orderkey % 23 = 5 then 2 else 1 end as copies
        from ({_ORDER_BASE}) as b) as k
) as r
where copy <= copies
"""

_DMY = "substr(d, 9, 2) || '-' || substr(d, 6, 2) || '-' || substr(d, 1, 4)"
_MDY = "substr(d, 6, 2) || '/' || substr(d, 9, 2) || '/' || substr(d, 1, 4)"

# Upload rows as text, numbered from 2 like the lines of a file with a header.
UPLOAD_ROWS = f"""
select o_orderkey + 2 as row_number,
       case when o_orderkey % 3 = 0 then 'U001' else 'CA02' end as business_code,
       case when k = 1 then ' ' else 'C' || cast(o_custkey as string) end as customer_id,
       {_CUSTOMER_NAME} as customer_name,
       case when is_open = 1 then '' when k = 2 then '2001-02-31'
            else cast(posting_date + pay_days as string) end as clear_date,
       cast(year(posting_date) as string) || '.0' as business_year,
       cast(o_orderkey + 1000000 as string) as doc_id,
       case k when 3 then {_DMY} when 4 then {_MDY} when 5 then 'not-a-date'
              when 6 then replace(d, '-', '/') when 7 then '' else d end as posting_date,
       d as document_create_date,
       case when k = 8 then '13/13/2001' else d end as document_create_date_1,
       cast(posting_date + term as string) as due_date,
       case when o_orderkey % 10 = 7 then 'CAD' else 'USD' end as currency,
       'RV' as document_type,
       '1' as posting_id,
       case k when 9 then 'abc' when 10 then '' when 11 then '1e3'
              else ' ' || cast(cast(o_totalprice as decimal(18,2)) as string) end as invoice_amount,
       d as baseline_create_date,
       'NA' || cast(term as string) as payment_terms,
       case when k = 12 then '' when k = 16 then cast(o_orderkey - 1 as string)
            else cast(o_orderkey as string) end as invoice_id,
       case k when 13 then '3' when 14 then 'yes' when 15 then '' else cast(is_open as string) || '.0' end
         as is_open,
       case when is_open = 0 then cast(pay_days - term as string) end as payment_delay_days,
       case when is_open = 0 then case when pay_days > term then '1' else '0' end end as is_late
from (select *, o_orderkey % 31 as k, cast(posting_date as string) as d
      from ({_ORDER_BASE}) as b) as u
"""

# Assessments and actions as an earlier run could have left them, some now out of date. Every
# order gives one; where the run's invoices must not be stored yet, the key is shifted to that
# of an invoice that is gone.
OLD_ASSESSMENTS = f"""
select 'A' || cast(stored_key as string) as assessment_id,
       case when o_orderkey % 7 = 1 then null else cast(stored_key as string) end as receivables_invoice,
       case when o_orderkey % 7 = 2 then null else cast(stored_key as string) end as external_invoice_id,
       cast(stored_key as string) as invoice_id,
       'C' || cast(o_custkey as string) as receivables_customer,
       'C' || cast(o_custkey as string) as customer_id,
       'Customer ' || cast(o_custkey as string) as customer_name,
       posting_date,
       posting_date + term as due_date,
       case when o_orderkey % 10 = 7 then 'CAD' else 'USD' end as currency,
       cast(o_totalprice as decimal(18,2)) as invoice_amount,
       case when o_orderkey % 9 = 0 then 0 when o_orderkey % 9 = 1 then null else 1 end as is_open,
       cast((o_orderkey * 3) % 130 as int) as days_overdue,
       cast(o_custkey % 101 as int) as customer_risk_score,
       case when o_custkey % 3 = 0 then 'High' when o_custkey % 3 = 1 then 'Medium' else 'Low' end
         as customer_risk_level,
       cast((o_orderkey * 7) % 101 as int) as risk_score,
       case when (o_orderkey * 7) % 101 >= 70 then 'High' when (o_orderkey * 7) % 101 >= 40 then 'Medium'
            when o_orderkey % 17 = 0 then null else 'Low' end as risk_level,
       'Monitor' as suggested_action,
       'Earlier run.' as explanation
from (select *, case when o_orderkey % 2 = 0 or is_open = 1 and o_orderkey % 3 = 0 then o_orderkey
                     else o_orderkey + 1000000000 end as stored_key
      from ({_ORDER_BASE}) as b) as b
"""

OLD_ACTIONS = f"""
select 'X' || cast(stored_key as string) as action_id,
       'C' || cast(o_custkey as string) as receivables_customer,
       cast(stored_key as string) as receivables_invoice,
       'A' || cast(stored_key as string) as invoice_risk_assessment,
       case when o_orderkey % 41 = 0 then '' else cast(stored_key as string) end as external_invoice_id,
       'C' || cast(o_custkey as string) as customer_id,
       'Customer ' || cast(o_custkey as string) as customer_name,
       case o_orderkey % 3 when 0 then 'Escalate Collection' when 1 then 'Immediate Follow-up'
            else 'Send Reminder' end as action_type,
       case o_orderkey % 3 when 0 then 'High' when 1 then 'High' else 'Medium' end as priority,
       case o_orderkey % 6 when 0 then 'Open' when 1 then 'Contacted' when 2 then 'Promised to Pay'
            when 3 then 'Escalated' when 4 then 'Resolved' else '' end as status,
       posting_date + term as due_date,
       case o_orderkey % 4 when 0 then null when 1 then '' else 'Called on day one.' end as notes,
       case when o_orderkey % 6 = 4 then null else cast(stored_key as string) || ':old' end
         as active_invoice_key,
       cast((o_orderkey * 7) % 101 as int) as created_from_risk_score
from (select *, case when o_orderkey % 4 <> 3 then o_orderkey else o_orderkey + 1000000000 end as stored_key
      from ({_ORDER_BASE}) as b) as b
"""

# Public payment reports: one per supplier and quarter of shipment, as raw text, with some
# reports filed twice.
PAYMENT_REPORTS = """
select report_id as "Report Id",
       case when q % 2 = 0 then 'Regime 1' else 'Regime 2' end as "Policy Regime",
       cast(make_date(y, 1, 1) as string) as "Financial period start date",
       case when k = 31 then '31/12/2000' else cast(period_start as string) end as "Start date",
       case when k = 32 then 'None' else cast(period_start + 89 as string) end as "End date",
       cast(period_start + 120 as string) as "Filing date",
       case when k = 33 then 'n/a' else ' Supplier   ' || cast(l_suppkey as string) || ' plc ' end as "Company",
       case when l_suppkey % 12 = 5 then 'sc' || cast(100000 + l_suppkey as string)
            when l_suppkey % 40 = 9 then '' else cast(l_suppkey as string) end as "Company number",
       case when k = 34 then '' when k = 35 then '-3' when k = 36 then '400'
            else cast(cast(floor(cast(days as double) / n) as int) as string) || '.'
                 || cast(cast(days % 10 as int) as string) end as "Average time to pay",
       '£' || thousands || ',' || units || '.50' as "Total value invoices paid within 30 days",
       thousands as "Total value invoices paid between 31 and 60 days",
       case when k = 37 then '(12.5)' when k = 38 then 'NULL' else units end
         as "Total value invoices paid later than 60 days",
       cast(pct30 as string) || '%' as "% Invoices paid within 30 days",
       cast(pct60 as string) as "% Invoices paid between 31 and 60 days",
       case when k = 39 then '101' else cast(100 - pct30 - pct60 as string) end
         as "% Invoices paid later than 60 days",
       units || '.25' as "Total value invoices paid later than agreed terms",
       case when k = 40 then 'nan' else cast(late_pct as string) end as "% Invoices not paid within agreed terms",
       cast(cast(n % 7 as int) as string) as "% Invoices not paid due to dispute",
       cast(cast(14 + l_suppkey % 60 as int) as string) as "Shortest (or only) standard payment period",
       case when k % 5 = 0 then '' else cast(cast(30 + (l_suppkey * 3) % 60 as int) as string) end
         as "Longest standard payment period",
       case when k % 4 = 0 then ' ' else 'Net 30 days' end as "Standard payment terms",
       case k % 10 when 0 then 'Yes' when 1 then 'no'
            when 2 then 'We moved suppliers to new standard terms after COVID-19'
            when 3 then 'No change to policy' when 4 then 'N/A' when 5 then ''
            when 6 then 'Vendor contract processes revised' when 7 then 'true'
            when 8 then 'Terms were not changed' else 'Shorter lockdown cover' end
         as "Payment terms have changed",
       case k % 5 when 0 then 'TRUE' when 1 then 'n' when 2 then 'By letter' when 3 then 'none' else '0' end
         as "Suppliers notified of changes",
       cast(cast(60 + l_suppkey % 30 as int) as string) as "Maximum contractual payment period",
       'See contract' as "Maximum contractual payment period information",
       '' as "Other information payment terms",
       case k % 3 when 0 then 'y' when 1 then 'False' else ' Prompt code ' end as "Participates in payment codes",
       case k % 2 when 0 then 'true' else 'false' end as "E-Invoicing offered",
       case k % 6 when 0 then 'NaN' when 1 then '1' else 'No' end as "Supply-chain financing offered",
       'https://example.org/report/' || report_id as "URL"
from (
  select *, {each 1, 2} as copy, cast(l_suppkey as string) || '-' || cast(y as string) || '-' || cast(q as string) as report_id,
         cast((l_suppkey * 7 + y * 4 + q) % 60 as int) as k,
         make_date(y, (q - 1) * 3 + 1, 1) as period_start,
         cast(floor(100 * cast(n30 as double) / n) as int) as pct30,
         cast(floor(100 * cast(n60 as double) / n) as int) as pct60,
         cast(floor(100 * cast(late as double) / n) as int) as late_pct,
         cast(cast(days % 997 as int) as string) as thousands,
         lpad(cast(cast((days * 17) % 1000 as int) as string), 3, '0') as units
  from (
    select l_suppkey, cast(year(l_shipdate) as int) as y, cast(quarter(l_shipdate) as int) as q,
           cast(count(*) as bigint) as n,
           cast(sum(d) as bigint) as days,
           cast(sum(case when d <= 30 then 1 else 0 end) as bigint) as n30,
           cast(sum(case when d > 30 and d <= 60 then 1 else 0 end) as bigint) as n60,
           cast(sum(case when d > 45 then 1 else 0 end) as bigint) as late
    from (select l_suppkey, l_shipdate,
                 (l_orderkey * 7 + l_linenumber * 13 + l_suppkey) % (20 + l_suppkey % 100) as d
          from {lineitem}) as x
    group by l_suppkey, cast(year(l_shipdate) as int), cast(quarter(l_shipdate) as int)
  ) as g
) as p
where copy = 1 or (l_suppkey % 20 = 3 and q = 2)
"""

# Financial facts: several filed values per supplier and concept, some unusable, with equal
# filing dates to exercise the tie rules. Concepts a supplier must lack keep their rows under an
# unused name. ``pos`` is the place in the document's array.
FACT_ROWS = """
select l_suppkey,
       case when l_suppkey % skip = 1 or l_suppkey % 37 = 36 then 'Unused' || concept else concept end as concept,
       cast((y - 1990) * 8 + variant as int) as pos,
       case when variant = 3 and (l_suppkey + y) % 5 = 0 then 'n.a.'
            else cast(base * weight + variant as string) end as val,
       case when variant = 2 and y % 3 = 0 then '' when variant = 3 and y % 4 = 0 then 'soon'
            else cast(make_date(y + 1, 1, 30) as string) end as filed,
       case when variant = 2 and y % 6 = 0 then ''
            else cast(make_date(y, 12, 31) as string) end as "end",
       case variant when 0 then '10-K' when 1 then '8-K' when 2 then '10-Q' else '20-F' end as form
from (
  select *,
         case concept_no when 0 then 'Revenues' when 1 then 'SalesRevenueNet'
              when 2 then 'CashAndCashEquivalentsAtCarryingValue'
              when 3 then 'CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents'
              when 4 then 'AssetsCurrent' when 5 then 'LiabilitiesCurrent' when 6 then 'Assets'
              when 7 then 'Liabilities' when 8 then 'StockholdersEquity'
              when 9 then 'AccountsPayableCurrent' when 10 then 'OperatingIncomeLoss'
              when 11 then 'NetIncomeLoss' when 12 then 'ProfitLoss' else 'UnusedConcept' end as concept,
         case concept_no when 0 then 9 when 1 then 8 when 2 then 1 when 3 then 2 when 4 then 5
              when 5 then 4 when 6 then 12 when 7 then 9 when 8 then -1 when 9 then 2
              when 11 then -1 else 1 end as weight,
         case concept_no when 0 then 4 when 1 then 9 when 2 then 6 when 3 then 7 when 4 then 11
              when 5 then 13 when 6 then 17 when 7 then 19 when 8 then 5 when 9 then 8
              when 10 then 10 when 11 then 3 when 12 then 4 else 50 end as skip
  from (
    select *, {each 0, 1, 2, 3} as variant
    from (
      select *, {each 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13} as concept_no
      from (
        select l_suppkey, cast(year(l_shipdate) as int) as y,
               cast(sum(l_orderkey % 1000 + l_linenumber) as bigint) as base
        from {lineitem}
        group by l_suppkey, cast(year(l_shipdate) as int)
      ) as g
    ) as per_concept
  ) as per_variant
) as f
"""

# Scored test rows: a label and a probability with three decimals.
SCORED_ROWS = """
select l_linenumber as model_number,
       case when l_returnflag = 'R' then 1 else 0 end as label,
       cast(case when l_returnflag = 'R'
                 then 300 + (l_orderkey * 31 + l_linenumber * 17) % 700
                 else (l_orderkey * 29 + l_linenumber * 13) % (700 + l_linenumber * 20) end as double) / 1000 as score
from {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A mapping over the sample tables of one folder."""
    tune(spark)
    used = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem") if "{" + n + "}" in text}
    text = re.sub(r"\{each ([^}]*)\}", r"explode(array(\1))", text)
    return spark.sql(text.replace('"', "`"), **used)


def duckdb_text(text: str) -> str:
    """The same mapping for an engine that has the tables registered by name."""
    text = re.sub(r"\{each ([^}]*)\}", r"unnest([\1])", text)
    return text.replace("{orders}", "orders").replace("{lineitem}", "lineitem")
