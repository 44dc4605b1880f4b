"""DuckDB SQL for the receivables queries."""

from __future__ import annotations

from ledgermill.sources import sample_tables as samples

INPUTS = {
    "invoices": samples.INVOICES,
    "raw": samples.RAW_INVOICES,
    "uploads": samples.UPLOAD_ROWS,
    "old_assessments": samples.OLD_ASSESSMENTS,
    "old_actions": samples.OLD_ACTIONS,
}

WHITE = r"'^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$'"


def _blank(c):
    return f"nullif(trim({c}), '')"


def _real(c):
    start = rf"regexp_extract({c}, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
    return f"case when {c} is not null then coalesce(try_cast(nullif({start}, '') as double), 0.0) end"


def _whole(c):
    return f"try_cast(trunc({_real(c)}) as integer)"


def _rolling(text, y, m, d, shape):
    return (
        f"case when regexp_matches({text}, '{shape}')"
        f" and cast(substr({text}, {m}, 2) as int) between 1 and 12"
        f" and cast(substr({text}, {d}, 2) as int) between 1 and 31"
        f" then make_date(cast(substr({text}, {y}, 4) as int), cast(substr({text}, {m}, 2) as int), 1)"
        f" + (cast(substr({text}, {d}, 2) as int) - 1) end"
    )


def _iso(c):
    return _rolling(f"substr({_blank(c)}, 1, 10)", 1, 6, 9, "^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def _compact(c):
    start = rf"nullif(regexp_extract({_blank(c)}, '^\s*([+-]?[0-9]+)', 1), '')"
    number = f"(case when {_blank(c)} is not null then coalesce(try_cast({start} as bigint), 0) end)"
    text = f"printf('%08d', {number})"
    return _rolling(text, 1, 5, 7, "^[0-9]{8}")


def _id_text(c):
    return f"printf('%.0f', coalesce({_real(_blank(c))}, 0.0))"


CLEAN = {
    "normalized": f"""
select distinct {_blank('business_code')} as business_code, {_blank('customer_id_raw')} as customer_id,
  {_blank('customer_name_raw')} as customer_name, {_iso('clear_date_raw')} as clear_date,
  {_whole(_blank('business_year_raw'))} as business_year, {_id_text('doc_id_raw')} as doc_id,
  {_iso('posting_date_raw')} as posting_date, {_compact('document_create_date_raw')} as document_create_date,
  {_compact('document_create_date_1_raw')} as document_create_date_1, {_compact('due_date_raw')} as due_date,
  {_blank('invoice_currency_raw')} as currency, {_blank('document_type_raw')} as document_type,
  {_whole(_blank('posting_id_raw'))} as posting_id, {_real(_blank('invoice_amount_raw'))} as invoice_amount,
  {_compact('baseline_create_date_raw')} as baseline_create_date, {_blank('payment_terms_raw')} as payment_terms,
  {_id_text('invoice_id_raw')} as invoice_id, {_whole(_blank('is_open_raw'))} as is_open
from raw""",
    "reviewed": """
select *, case
  when invoice_id is null or invoice_id = '0' then 'Missing invoice ID'
  when customer_id is null then 'Missing customer'
  when posting_date is null then 'Invalid posting date'
  when due_date is null then 'Invalid due date'
  when invoice_amount is null or invoice_amount <= 0 then 'Invalid invoice amount'
  when is_open not in (0, 1) then 'Invalid open status'
  when is_open = 0 and clear_date is null then 'Closed invoice missing clear date'
  when is_open = 1 and clear_date is not null then 'Open invoice has clear date'
  when clear_date is not null and clear_date < posting_date then 'Clear date before posting date'
  end as rejection_reason
from normalized""",
    "clean": """
select * exclude (rejection_reason),
  cast(datediff('day', due_date, clear_date) as integer) as payment_delay_days,
  case when clear_date is null then null when clear_date > due_date then 1 else 0 end as is_late
from reviewed where rejection_reason is null""",
    "labeled": "select * from clean where is_open = 0 and clear_date is not null",
    "unpaid": "select * from clean where is_open = 1 and clear_date is null",
}


def _strip(c):
    return f"nullif(regexp_replace({c}, {WHITE}, '', 'g'), '')"


def _number(c):
    return (
        rf"case when regexp_matches({_strip(c)}, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
        f" then try_cast({_strip(c)} as double) end"
    )


def _day(c):
    t = _strip(c)
    forms = [
        ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "%Y-%m-%d"),
        ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "%d-%m-%Y"),
        ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "%m/%d/%Y"),
        ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "%d/%m/%Y"),
        ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "%Y/%m/%d"),
    ]
    tries = ", ".join(
        f"case when regexp_matches({t}, '{shape}') then cast(try_strptime({t}, '{form}') as date) end"
        for shape, form in forms
    )
    return f"coalesce({tries})"


_REQUIRED = ["customer_id", "invoice_id", "posting_date", "due_date", "invoice_amount", "is_open"]
_DATES = ["posting_date", "due_date", "clear_date", "document_create_date", "document_create_date_1",
          "baseline_create_date"]
_CHECKS = (
    [f"case when {_strip(c)} is null then 'Missing {c}' end" for c in _REQUIRED]
    + [
        f"case when {_strip('invoice_amount')} is not null and {_number('invoice_amount')} is null"
        " then 'Invalid invoice_amount' end",
        f"case when {_strip('is_open')} is not null and {_number('is_open')} is null then 'Invalid is_open'"
        f" when trunc({_number('is_open')}) not in (0, 1) then 'is_open must be 0 or 1' end",
    ]
    + [f"case when {_strip(c)} is not null and {_day(c)} is null then 'Invalid {c}' end" for c in _DATES]
)
_DUE = _day("due_date")
_OPEN = f"coalesce(trunc({_number('is_open')}), 0) = 1"

UPLOAD = {
    "validated": f"""
select *, list_filter([{', '.join(_CHECKS)}], lambda e: e is not null) as errors from uploads""",
    "errors": """
select row_number, cast(p - 1 as integer) as position,
  'Row ' || cast(row_number as varchar) || ': ' || errors[p] as message
from (select row_number, errors, unnest(range(1, len(errors) + 1)) as p from validated) as e""",
    "imported": f"""
select * replace (cast(days_overdue as integer) as days_overdue),
  case when is_open = 0 then 'Closed' when days_overdue > 0 then 'Overdue' else 'Open' end as status
from (
  select row_number, {', '.join(f'{_strip(c)} as {c}' for c in
      ['business_code', 'customer_id', 'customer_name', 'doc_id', 'currency', 'document_type',
       'payment_terms', 'invoice_id'])},
    {', '.join(f'{_day(c)} as {c}' for c in
      ['clear_date', 'posting_date', 'document_create_date', 'document_create_date_1', 'due_date',
       'baseline_create_date'])},
    {', '.join(f'try_cast(trunc({_number(c)}) as integer) as {c}' for c in
      ['business_year', 'posting_id', 'payment_delay_days'])},
    cast(coalesce({_number('invoice_amount')}, 0) as decimal(18,2)) as invoice_amount,
    case when {_OPEN} then 1 else 0 end as is_open,
    case when {_OPEN} then 'Unknown' when {_number('is_late')} = 1 then 'Late' else 'On Time' end
      as late_payment_status,
    case when {_OPEN} and {_DUE} is not null
         then greatest(datediff('day', {_DUE}, date '2001-07-01'), 0) else 0 end as days_overdue
  from validated where len(errors) = 0
) as t""",
}

CUSTOMERS = {
    "label_counts": """
select customer_id, customer_name, currency, business_code, count(*) as n
from invoices where customer_id <> '' group by all""",
    "labels": """
select * from (
  select *, row_number() over (partition by customer_id order by n desc, customer_name nulls first,
    currency nulls first, business_code nulls first) as place
  from label_counts) as l
where place = 1""",
    "metrics": """
select i.customer_id, any_value(l.customer_name) as customer_name,
  any_value(l.currency) as default_currency, any_value(l.business_code) as business_code,
  count(*) as total_invoices,
  cast(sum(case when coalesce(is_open, 0) = 0 then 1 else 0 end) as bigint) as closed_invoice_count,
  cast(sum(case when coalesce(is_open, 0) = 1 then 1 else 0 end) as bigint) as open_invoice_count,
  cast(sum(coalesce(invoice_amount, 0)) as double) as total_invoice_amount,
  cast(coalesce(sum(case when is_open = 1 then invoice_amount end), 0) as double) as open_amount,
  coalesce(cast(sum(case when coalesce(is_open, 0) = 0 then payment_delay_days end) as double)
    / nullif(count(case when coalesce(is_open, 0) = 0 then payment_delay_days end), 0), 0.0)
    as average_payment_delay,
  coalesce(cast(sum(case when coalesce(is_open, 0) = 0 and late_payment_status = 'Late' then 1 else 0 end) as double)
    / nullif(sum(case when coalesce(is_open, 0) = 0 then 1 else 0 end), 0), 0.0) * 100 as late_payment_rate,
  min(posting_date) as first_invoice_date, max(posting_date) as last_invoice_date
from invoices as i join labels as l on i.customer_id = l.customer_id
group by i.customer_id""",
}

DEFAULT_WEIGHTS = {"late": (25, 15), "count": (15, 10, 5), "amount": (20, 15, 10),
                   "overdue": (35, 25, 15, 8), "large": (20, 15, 10), "levels": (40, 70)}
CUSTOM_WEIGHTS = {**DEFAULT_WEIGHTS, "levels": (20, 45)}
STOCK_WEIGHTS = {**DEFAULT_WEIGHTS, "late": (30, 20), "overdue": (40, 30, 15, 8)}


def _times(value, words, weight):
    return (f"'{value} amount is more than {words} times the customer''s average invoice amount, "
            f"adding {weight} points.'")


def scored_customers(w):
    """Points and sentences of every rule in one derived table, then the score."""
    lh, lm = w["late"]
    c1, c2, c3 = w["count"]
    a1, a2, a3 = w["amount"]
    medium, high = w["levels"]
    return f"""
select *, case when risk_explanation0 = '' then 'No risk rules were triggered. Customer is classified as '
    || risk_level || ' risk.' else risk_explanation0 || ' Final classification: ' || risk_level || ' risk.' end
    as risk_explanation
from (
  select *, case when risk_score >= {high} then 'High' when risk_score >= {medium} then 'Medium' else 'Low' end
    as risk_level,
    case when closed_invoice_count >= 10 then 'High' when closed_invoice_count >= 3 then 'Medium' else 'Low' end
    as risk_confidence,
    concat_ws(' ', r1, r2, r3, r4, r5, r6) as risk_explanation0
  from (
    select *, cast(least(100, greatest(0,
        case when closed_invoice_count < 3 then least(p1 + p2, 25) else p1 + p2 end + p4 + p5
        + case when closed_invoice_count = 0 then 10 else 0 end)) as integer) as risk_score
    from (
      select m.*,
        case when late_payment_rate > 50 then {lh} when late_payment_rate > 30 then {lm} else 0 end as p1,
        case when late_payment_rate > 50 then 'Late payment rate is high at ' || printf('%.1f', late_payment_rate)
               || '%, adding {lh} points.'
             when late_payment_rate > 30 then 'Late payment rate is elevated at '
               || printf('%.1f', late_payment_rate) || '%, adding {lm} points.' end as r1,
        case when average_payment_delay > 15 then 20 when average_payment_delay > 7 then 12
             when average_payment_delay > 3 then 5 else 0 end as p2,
        case when average_payment_delay > 15 then 'Average payment delay is high at '
               || printf('%.1f', average_payment_delay) || ' days, adding 20 points.'
             when average_payment_delay > 7 then 'Average payment delay is elevated at '
               || printf('%.1f', average_payment_delay) || ' days, adding 12 points.'
             when average_payment_delay > 3 then 'Average payment delay is slightly elevated at '
               || printf('%.1f', average_payment_delay) || ' days, adding 5 points.' end as r2,
        case when closed_invoice_count < 3 then 'Payment history is limited, so confidence is low and payment '
          || 'behavior risk is capped at 25 points.' end as r3,
        case when open_invoice_count >= 10 then {c1} when open_invoice_count >= 3 then {c2}
             when open_invoice_count >= 1 then {c3} else 0 end as p4,
        case when open_invoice_count >= 3 then 'Customer has ' || open_invoice_count || ' open invoices, adding '
               || case when open_invoice_count >= 10 then {c1} else {c2} end || ' points.'
             when open_invoice_count >= 1 then 'Customer has ' || open_invoice_count
               || ' open invoice, adding {c3} points.' end as r4,
        case when avg_amount <= 0 then 0 when open_amount > avg_amount * 5 then {a1}
             when open_amount > avg_amount * 3 then {a2}
             when open_amount > avg_amount * 1.5::double then {a3} else 0 end as p5,
        case when avg_amount <= 0 then null when open_amount > avg_amount * 5 then {_times('Open', 'five', a1)}
             when open_amount > avg_amount * 3 then {_times('Open', 'three', a2)}
             when open_amount > avg_amount * 1.5::double then {_times('Open', '1.5', a3)} end as r5,
        case when closed_invoice_count = 0 then 'Customer has no closed invoice history, adding 10 points.' end as r6
      from (select *, case when total_invoices > 0 then total_invoice_amount / total_invoices else 0 end
              as avg_amount from metrics) as m
    ) as rules
  ) as points
) as levels"""


def assessed(w):
    h1, h2, h3, h4 = w["overdue"]
    a1, a2, a3 = w["large"]
    medium, high = w["levels"]
    return f"""
select receivables_invoice, external_invoice_id, invoice_id, receivables_customer, customer_id, customer_name,
  posting_date, due_date, currency, invoice_amount, is_open, days_overdue, customer_risk_score,
  customer_risk_level, risk_score, risk_level, suggested_action,
  case when said = '' then 'No invoice risk rules were triggered. Invoice is classified as ' || risk_level
       || ' risk. Suggested action: ' || suggested_action || '.'
       else said || ' Final classification: ' || risk_level || ' risk. Suggested action: ' || suggested_action || '.'
  end as explanation
from (
  select *, case when risk_level = 'High' and days_overdue > 30 then 'Escalate Collection'
      when risk_level = 'High' then 'Immediate Follow-up' when risk_level = 'Medium' then 'Send Reminder'
      else 'Monitor' end as suggested_action
  from (
    select *, case when risk_score >= {high} then 'High' when risk_score >= {medium} then 'Medium' else 'Low' end
      as risk_level
    from (
      select *, cast(least(100, p1 + p2 + p3) as integer) as risk_score, concat_ws(' ', r1, r2, r3) as said
      from (
        select *,
          case when days_overdue > 60 then {h1} when days_overdue > 30 then {h2} when days_overdue > 15 then {h3}
               when days_overdue > 0 then {h4} else 0 end as p1,
          case when days_overdue > 0 then 'Invoice is ' || printf('%.1f', days_overdue::double)
            || ' days overdue, adding ' || case when days_overdue > 60 then {h1} when days_overdue > 30 then {h2}
               when days_overdue > 15 then {h3} else {h4} end || ' points.' end as r1,
          case customer_risk_level when 'High' then 30 when 'Medium' then 15 else 0 end as p2,
          'Customer risk level is ' || customer_risk_level || ', adding '
            || case customer_risk_level when 'High' then 30 when 'Medium' then 15 else 0 end || ' points.' as r2,
          case when avg_amount <= 0 then 0 when amount > avg_amount * 5 then {a1}
               when amount > avg_amount * 3 then {a2}
               when amount > avg_amount * 1.5::double then {a3} else 0 end as p3,
          case when avg_amount <= 0 then null when amount > avg_amount * 5 then {_times('Invoice', 'five', a1)}
               when amount > avg_amount * 3 then {_times('Invoice', 'three', a2)}
               when amount > avg_amount * 1.5::double then {_times('Invoice', '1.5', a3)} end as r3
        from (
          select i.invoice_id as receivables_invoice, i.invoice_id as external_invoice_id, i.invoice_id,
            c.customer_id as receivables_customer, c.customer_id, c.customer_name, i.posting_date, i.due_date,
            i.currency, i.invoice_amount, i.is_open,
            cast(greatest(datediff('day', i.due_date, (select max(posting_date) from invoices)), 0) as integer)
              as days_overdue,
            c.risk_score as customer_risk_score, c.risk_level as customer_risk_level,
            cast(i.invoice_amount as double) as amount, c.avg_amount
          from invoices as i join scored as c on i.customer_id = c.customer_id
          where i.is_open = 1
        ) as j
      ) as rules
    ) as points
  ) as levels
) as acts"""


def risk_tables(w):
    return {"scored": scored_customers(w), "assessed": assessed(w)}


_LOW = risk_tables(CUSTOM_WEIGHTS)

STATE = {
    "identified": "select *, 'A' || external_invoice_id as assessment_id from assessed",
    "merged": """
select case when n.key is null then o.assessment_id when o.assessment_id is null then 'new:' || n.external_invoice_id
       else o.assessment_id end as assessment_id,
  """ + ",\n  ".join(
        f"case when n.key is not null then n.{c} else o.{c} end as {c}"
        for c in ["receivables_invoice", "external_invoice_id", "invoice_id", "receivables_customer", "customer_id",
                  "customer_name", "posting_date", "due_date", "currency", "invoice_amount", "is_open",
                  "days_overdue", "customer_risk_score", "customer_risk_level", "risk_score", "risk_level",
                  "suggested_action", "explanation"]
    ) + """,
  o.risk_score as previous_risk_score, o.risk_level as previous_risk_level,
  case when n.key is null then 'kept' when o.assessment_id is null then 'created' else 'updated' end as merge_status
from old_assessments as o
full outer join (
  select f.*, coalesce(e.assessment_id, r.assessment_id, 'fresh ' || f.external_invoice_id) as key
  from assessed as f
  left join old_assessments as e on e.external_invoice_id = f.external_invoice_id
  left join old_assessments as r on r.receivables_invoice = f.receivables_invoice
) as n on o.assessment_id = n.key""",
    "resolved": """
select a.* replace (
    case when hit then 'Resolved' else a.status end as status,
    case when hit then null else a.active_invoice_key end as active_invoice_key,
    case when hit then case when coalesce(a.notes, '') = '' then '' else a.notes || chr(10) || chr(10) end
      || 'Auto-resolved because linked Invoice Risk Assessment ' || s.assessment_id || ' for invoice '
      || coalesce(s.external_invoice_id, 'None') || ' is closed.' else a.notes end as notes),
  hit as resolved_now
from (select x.*, exists (select 1 from old_assessments as o where o.assessment_id = x.invoice_risk_assessment
        and coalesce(o.is_open, 0) = 0) and x.status <> 'Resolved' as hit from old_actions as x) as a0
cross join lateral (select a0.* exclude (hit)) as a
left join old_assessments as s on s.assessment_id = a.invoice_risk_assessment""",
    "candidates": """
select *, case when risk_level = 'High' and days_overdue > 30 then 'Escalate Collection'
    when risk_level = 'High' then 'Immediate Follow-up' else 'Send Reminder' end as action_type,
  risk_level as priority,
  case when risk_level = 'High' then today else today + 3 end as action_due_date,
  case when risk_level = 'High' and days_overdue > 30 then 'High-risk invoice ' || external_invoice_id || ' is '
      || days_overdue || ' days overdue. Escalate collection immediately.'
    when risk_level = 'High' then 'High-risk invoice ' || external_invoice_id || ' requires immediate follow-up.'
    else 'Medium-risk invoice ' || external_invoice_id || '. Send payment reminder.' end as notes
from (select *, (select max(posting_date) from invoices) as today from identified) as t
where is_open = 1 and risk_level in ('Medium', 'High')""",
}


def _from(query, *groups):
    """A query with the derived tables it may use in front."""
    tables = {name: samples.duckdb_text(text) for name, text in INPUTS.items()}
    for group in groups:
        tables.update(group)
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in tables.items()) + "\n" + query


def _levels(names):
    return ", ".join(f"('{n}', {i})" for i, n in enumerate(names))


_RISK = "customer_id, risk_score, risk_level, risk_confidence, risk_explanation"
_MONEY = "* replace (cast(invoice_amount as double) as invoice_amount)"
_BENT_KEY = "cast(substr(customer_id, 2) as bigint)"


def _violations(source, key, rules):
    listed = ", ".join(f"case when {test} then '{text}' end" for test, text in rules)
    return f"""
select record, cast(p - 1 as integer) as position, found[p] as message from (
  select record, found, unnest(range(1, len(found) + 1)) as p from (
    select {key} as record, list_filter([{listed}], lambda e: e is not null) as found from ({source}) as s) as f) as u"""


def _level_rule(c, label):
    return f"{c} <> '' and {c} not in ('Low', 'Medium', 'High')", f"{label} must be Low, Medium, or High."


def _score_rule(c, label):
    return f"{c} < 0 or {c} > 100", f"{label} must be between 0 and 100."


def _negative_rule(c, label):
    return f"{c} < 0", f"{label} cannot be negative."


def _audit(source, doc, entity, name, external, reason, label):
    return f"""
select * from (
  select '{doc}' as reference_doctype, {name} as reference_name, '{entity}' as entity_type, customer_id,
    {external} as external_invoice_id, coalesce(previous_risk_score, 0) as previous_score,
    coalesce(risk_score, 0) as new_score, coalesce(previous_risk_level, '') as previous_level,
    coalesce(nullif(risk_level, ''), 'Low') as new_level, {reason} as reason, '{label}' as source
  from {source}) as c
where previous_score <> new_score or previous_level <> new_level"""


_AUDIT_ASSESSMENTS = _audit(
    "(select * from merged where merge_status = 'updated')", "Invoice Risk Assessment", "Invoice",
    "assessment_id", "external_invoice_id", "explanation", "Invoice Risk")

_BLOCKED = """
select distinct external_invoice_id, action_type from resolved
where coalesce(status, '') <> 'Resolved' and external_invoice_id <> '' and action_type <> ''"""

ORACLES = {
    "clean_reasons": _from(
        "select coalesce(rejection_reason, 'Accepted') as status, count(*) as rows from reviewed group by 1", CLEAN),
    "clean_invoices": _from("select * from clean", CLEAN),
    "clean_row_counts": _from("""
select 'raw_rows' as metric, count(*) as value from raw
union all select 'normalized_rows', count(*) from normalized
union all select 'clean_rows', count(*) from clean
union all select 'rejected_rows', count(*) from reviewed where rejection_reason is not null
union all select 'labeled_paid_rows', count(*) from labeled
union all select 'open_invoice_rows', count(*) from unpaid""", CLEAN),
    "clean_currency_totals": _from("""
select currency, count(*) as invoices,
  cast(round(sum(cast(invoice_amount as decimal(28,6))), 2) as double) as total_invoice_amount
from clean group by currency""", CLEAN),
    "clean_labeled_summary": _from("""
select min(posting_date) as earliest_posting_date, max(posting_date) as latest_posting_date,
  cast(printf('%.2f', avg(payment_delay_days)) as double) as avg_payment_delay_days,
  cast(printf('%.2f', 100.0::double * avg(is_late)) as double) as late_payment_rate_percent
from labeled""", CLEAN),
    "clean_labeled": _from("select * from labeled", CLEAN),
    "clean_open": _from("select * from unpaid", CLEAN),
    "clean_training_view": _from("""
select customer_id, customer_name, invoice_id, posting_date, due_date, invoice_amount, currency, payment_terms,
  is_open, payment_delay_days, is_late from clean""", CLEAN),
    "clean_repeated_ids": _from(
        "select invoice_id, count(*) as row_count from reviewed group by 1 having count(*) > 1", CLEAN),
    "csv_row_errors": _from("select * from errors", UPLOAD),
    "csv_totals": _from("""
select *, case when error_count > 0 and valid_rows = 0 then 'Validation Failed' else 'Validated' end as status,
  'Total rows: ' || total_rows || chr(10) || 'Valid rows: ' || valid_rows || chr(10) || 'Invalid rows: '
    || invalid_rows as validation_summary
from (
  select count(*) as total_rows, count(*) filter (len(errors) = 0) as valid_rows,
    count(*) filter (len(errors) > 0) as invalid_rows, cast(sum(len(errors)) as bigint) as error_count
  from validated) as t""", UPLOAD),
    "csv_error_summary": _from("""
select (select string_agg(message, chr(10) order by row_number, position) from
    (select * from errors order by row_number, position limit 20) as f)
  || case when count(*) > 20 then chr(10) || '... ' || (count(*) - 20) || ' more errors' else '' end as error_summary,
  count(*) as error_count from errors""", UPLOAD),
    "import_rows": _from(f"select {_MONEY} from imported", UPLOAD),
    "import_customer_merge": _from("""
select coalesce(n.customer_id, o.customer_id) as customer_id,
  case when n.customer_id is not null then n.customer_name else o.customer_name end as customer_name,
  case when n.customer_id is not null then n.business_code else o.business_code end as business_code,
  case when n.customer_id is not null then n.currency else o.default_currency end as default_currency,
  o.total_invoices, o.open_amount, case when o.customer_id is not null then 7 end as risk_score
from (select * replace (case when total_invoices > 9 then customer_id else 'OLD-' || customer_id end as customer_id)
  from metrics) as o
full outer join (select * from imported
  qualify row_number() over (partition by customer_id order by row_number desc) = 1) as n
  on o.customer_id = n.customer_id""", UPLOAD, CUSTOMERS),
    "import_invoice_merge": _from("""
select coalesce(n.invoice_id, o.invoice_id) as invoice_id, """ + ", ".join(
        f"case when n.invoice_id is not null then n.{c} else o.{c} end as {c}"
        for c in ["customer_id", "posting_date", "due_date", "clear_date", "is_open", "late_payment_status"]
    ) + """,
  cast(case when n.invoice_id is not null then n.invoice_amount else o.invoice_amount end as double) as invoice_amount,
  n.days_overdue, case when n.invoice_id is not null then n.status else 'Open' end as status
from (select * replace (case when is_open = 1 then invoice_id else 'OLD-' || invoice_id end as invoice_id,
    case when is_open = 1 then customer_id else 'OLD-' || customer_id end as customer_id) from invoices) as o
full outer join (select * from imported
  qualify row_number() over (partition by invoice_id order by row_number desc) = 1) as n
  on o.invoice_id = n.invoice_id""", UPLOAD),
    "upsert_counts": _from("""
select 'invoices' as entity, made as created, (select count(*) from imported) - made as updated from (
  select count(distinct invoice_id) as made from imported
  where invoice_id not in (select invoice_id from invoices where is_open = 1)) as i
union all
select 'customers', made, (select count(*) from imported) - made from (
  select count(distinct customer_id) as made from imported
  where customer_id not in (select customer_id from invoices where is_open = 1)) as c""", UPLOAD),
    "import_summary": _from("""
select customer_id, count(*) as invoice_count, min(posting_date) as first_invoice_date,
  max(posting_date) as last_invoice_date
from invoices where customer_id in (select customer_id from imported) group by customer_id""", UPLOAD),
    "quality_scorecard": _from("""
unpivot (
  select count(*) as total_invoices,
    count(*) filter (customer_id is null or trim(customer_id) = '') as missing_customer_id,
    count(*) filter (invoice_id is null or trim(invoice_id) = '') as missing_external_invoice_id,
    count(*) filter (due_date is null) as missing_due_date,
    count(*) filter (invoice_amount is null) as missing_invoice_amount,
    count(*) filter (is_open = 1) as open_invoices,
    count(*) filter (is_open = 0) as closed_invoices,
    count(distinct nullif(customer_id, '')) as unique_customers,
    count(*) filter (is_open is null or is_open not in (0, 1)) as invalid_open_flags,
    count(*) filter (invoice_amount < 0) as invoices_with_negative_amount,
    count(*) filter (is_open = 1 and clear_date is not null) as invoices_with_clear_date_but_open,
    count(*) filter (is_open = 0 and clear_date is null) as invoices_closed_without_clear_date
  from reviewed
) on columns(*) into name metric value value""", CLEAN),
    "customer_metrics": _from("select * from metrics", CUSTOMERS),
    "customer_ids": _from("select distinct customer_id from invoices where customer_id <> ''"),
    "customer_risk": _from(f"select {_RISK} from scored", CUSTOMERS, risk_tables(DEFAULT_WEIGHTS)),
    "customer_risk_custom": _from(f"select {_RISK} from scored", CUSTOMERS, _LOW),
    "customer_risk_stock": _from(f"select {_RISK} from scored", CUSTOMERS, risk_tables(STOCK_WEIGHTS)),
    "invoice_risk": _from(f"select {_MONEY} from assessed", CUSTOMERS, risk_tables(DEFAULT_WEIGHTS)),
    "invoice_risk_custom": _from(f"select {_MONEY} from assessed", CUSTOMERS, _LOW),
    "invoices_without_customer": _from("""
select customer_id, invoice_id from invoices where is_open = 1
  and customer_id not in (select customer_id from metrics where total_invoices > 9)""", CUSTOMERS),
    "assessment_merge": _from(f"select {_MONEY} from merged", CUSTOMERS, _LOW, STATE),
    "assessment_close": _from("""
select a.* replace (cast(a.invoice_amount as double) as invoice_amount,
    case when hit then 0 else a.is_open end as is_open, case when hit then 0 else a.risk_score end as risk_score,
    case when hit then 'Low' else a.risk_level end as risk_level,
    case when hit then 'No action - invoice closed' else a.suggested_action end as suggested_action,
    case when hit then 'Linked Receivables Invoice ' || a.receivables_invoice
      || ' is closed. No collection action is required.' else a.explanation end as explanation), hit as closed_now
from (select *, exists (select 1 from invoices as i where i.invoice_id = o.receivables_invoice
        and coalesce(i.is_open, 0) = 0) and coalesce(is_open, 0) <> 0 as hit from old_assessments as o) as h
cross join lateral (select h.* exclude (hit)) as a"""),
    "actions_new": _from(f"""
select receivables_customer, receivables_invoice, assessment_id as invoice_risk_assessment, external_invoice_id,
  customer_id, customer_name, action_type, priority, 'Open' as status, action_due_date as due_date, notes,
  1 as auto_generated, external_invoice_id || ':' || action_type as active_invoice_key,
  risk_score as created_from_risk_score
from candidates as c where not exists (select 1 from ({_BLOCKED}) as b
  where b.external_invoice_id = c.external_invoice_id and b.action_type = c.action_type)""",
        CUSTOMERS, _LOW, STATE),
    "actions_ranked": _from("""
select assessment_id, action_type, priority,
  row_number() over (order by risk_score desc nulls last, days_overdue desc nulls last, assessment_id asc nulls first) as generation_rank
from candidates""", CUSTOMERS, _LOW, STATE),
    "actions_skipped": _from(f"""
select action_type, priority, count(*) as skipped from candidates as c
where exists (select 1 from ({_BLOCKED}) as b
  where b.external_invoice_id = c.external_invoice_id and b.action_type = c.action_type)
group by all""", CUSTOMERS, _LOW, STATE),
    "actions_resolve": _from("select * from resolved", CUSTOMERS, _LOW, STATE),
    "audit_customers": _from(_audit(f"""(select *,
    case {_BENT_KEY} % 5 when 0 then risk_score when 1 then null else cast({_BENT_KEY} % 60 as integer) end
      as previous_risk_score,
    case {_BENT_KEY} % 5 when 0 then risk_level when 2 then 'High' end as previous_risk_level from scored)""",
        "Receivables Customer", "Customer", "customer_id", "cast(null as varchar)", "risk_explanation",
        "Customer Risk"), CUSTOMERS, _LOW),
    "audit_assessments": _from(_AUDIT_ASSESSMENTS, CUSTOMERS, _LOW, STATE),
    "customer_violations": _from(_violations(f"""
select * replace (case when {_BENT_KEY} % 5 = 0 then total_invoices + 1 else closed_invoice_count end
    as closed_invoice_count, case when {_BENT_KEY} % 11 = 0 then 101 else risk_score end as risk_score,
    case when {_BENT_KEY} % 13 = 0 then 'Severe' else risk_level end as risk_level),
  case when {_BENT_KEY} % 7 = 0 then -1 else total_invoices end as invoice_count from scored""", "customer_id", [
        _negative_rule("total_invoices", "Total Invoices"),
        _negative_rule("closed_invoice_count", "Closed Invoice Count"),
        _negative_rule("open_invoice_count", "Open Invoice Count"),
        _negative_rule("invoice_count", "Invoice Count"),
        ("total_invoices <> 0 and closed_invoice_count + open_invoice_count > total_invoices",
         "Closed Invoice Count plus Open Invoice Count cannot exceed Total Invoices."),
        _score_rule("risk_score", "Risk Score"), _level_rule("risk_level", "Risk Level"),
        _level_rule("risk_confidence", "Risk Confidence")]), CUSTOMERS, _LOW),
    "invoice_violations": _from(_violations("""
select * replace (case when n % 9 = 0 then -invoice_amount else invoice_amount end as invoice_amount,
  case when n % 10 = 0 then 'Late' else status end as status)
from (select *, try_cast(invoice_id as bigint) as n from imported) as i""", "invoice_id", [
        _negative_rule("invoice_amount", "Invoice Amount"), _negative_rule("days_overdue", "Days Overdue"),
        ("status not in ('Open', 'Closed', 'Overdue')", "Status must be Open, Closed, or Overdue."),
        ("late_payment_status not in ('Unknown', 'Late', 'On Time')",
         "Late Payment Status must be Unknown, Late, or On Time.")]), UPLOAD),
    "assessment_violations": _from(_violations("""
select * replace (days_overdue - 20 as days_overdue, customer_risk_score + 30 as customer_risk_score,
  case when cast(invoice_id as bigint) % 6 = 0 then 'None' else customer_risk_level end as customer_risk_level)
from old_assessments""", "assessment_id", [
        _score_rule("risk_score", "Risk Score"), _score_rule("customer_risk_score", "Customer Risk Score"),
        _level_rule("risk_level", "Risk Level"), _level_rule("customer_risk_level", "Customer Risk Level"),
        _negative_rule("days_overdue", "Days Overdue"), _negative_rule("invoice_amount", "Invoice Amount")])),
    "audit_violations": _from(_violations(
        f"select * replace (new_score + 40 as new_score) from ({_AUDIT_ASSESSMENTS}) as a", "reference_name", [
            _score_rule("previous_score", "Previous Score"), _score_rule("new_score", "New Score"),
            _level_rule("previous_level", "Previous Level"), _level_rule("new_level", "New Level")]),
        CUSTOMERS, _LOW, STATE),
    "action_keys": _from("""
select action_id, status, case when status = 'Resolved' then null
  when external_invoice_id <> '' and action_type <> '' then external_invoice_id || ':' || action_type
  else active_invoice_key end as active_invoice_key from old_actions"""),
    "action_duplicates": _from("""
select external_invoice_id, action_type, count(*) as active_actions from (
  select external_invoice_id, action_type from old_actions where coalesce(status, '') <> 'Resolved'
  union all select external_invoice_id, action_type from candidates) as a
where external_invoice_id <> '' and action_type <> '' group by all having count(*) > 1""", CUSTOMERS, _LOW, STATE),
    "rpt_customer": _from("""
select customer_id, customer_name, total_invoices, closed_invoice_count, open_invoice_count, total_invoice_amount,
  open_amount, average_payment_delay, late_payment_rate, risk_score, risk_level, risk_confidence, risk_explanation
from scored where open_amount >= 1 and late_payment_rate >= 10""", CUSTOMERS, _LOW),
    "rpt_invoice": _from("""
select external_invoice_id, customer_id, customer_name, due_date, days_overdue,
  cast(invoice_amount as double) as invoice_amount, customer_risk_score, customer_risk_level, risk_score, risk_level,
  suggested_action, explanation
from assessed where risk_level in ('Medium', 'High') and days_overdue >= 5""", CUSTOMERS, _LOW),
    "rpt_actions": _from("""
select external_invoice_id, customer_id, customer_name, action_type, priority, status, due_date,
  created_from_risk_score, notes from old_actions where status = 'Open' and priority = 'High'"""),
    "kpis": _from("""
select count(*) as total_customers, count(*) filter (risk_level = 'High') as high_risk_customers,
  cast(sum(cast(open_amount as decimal(28,2))) as double) as total_open_amount,
  cast(coalesce(sum(cast(open_amount as decimal(28,2))) filter (risk_level = 'High'), 0) as double)
    as high_risk_open_amount,
  (select count(*) from assessed where is_open = 1 and risk_level in ('Medium', 'High')) as medium_high_open_invoices,
  (select count(*) from old_actions where status <> 'Resolved') as open_collection_actions,
  (select count(*) from old_actions where status <> 'Resolved' and priority = 'High') as high_priority_open_actions
from scored""", CUSTOMERS, _LOW),
    "open_by_level": _from(f"""
select coalesce(l.n, g.n) as risk_level, coalesce(g.v, 0.0) as open_amount
from (values {_levels(['Low', 'Medium', 'High'])}) as l(n, i)
full outer join (select coalesce(nullif(risk_level, ''), 'Unclassified') as n,
  cast(sum(cast(open_amount as decimal(28,2))) as double) as v from scored group by 1) as g on l.n = g.n""",
        CUSTOMERS, _LOW),
    "dist_level": _from(f"""
select coalesce(l.n, g.n) as risk_level, coalesce(g.v, 0) as customer_count
from (values {_levels(['Low', 'Medium', 'High'])}) as l(n, i)
full outer join (select coalesce(nullif(risk_level, ''), 'Unclassified') as n, count(*) as v
  from scored group by 1) as g on l.n = g.n""", CUSTOMERS, _LOW),
    "aging": _from(f"""
select l.n as aging_bucket, coalesce(g.c, 0) as invoice_count, coalesce(g.v, 0.0) as invoice_amount
from (values {_levels(['Current', '1-30', '31-60', '61-90', '90+'])}) as l(n, i)
left join (select case when coalesce(days_overdue, 0) <= 0 then 'Current' when days_overdue <= 30 then '1-30'
    when days_overdue <= 60 then '31-60' when days_overdue <= 90 then '61-90' else '90+' end as n,
  count(*) as c, cast(sum(invoice_amount) as double) as v from assessed where is_open = 1 group by 1) as g
  on l.n = g.n""", CUSTOMERS, _LOW),
    "actions_by_status": _from("""
select coalesce(nullif(status, ''), 'Unclassified') as status, count(*) as action_count from old_actions group by 1"""),
    "overdue_by_month": _from("""
select strftime(due_date, '%Y-%m') as due_month, count(*) as invoice_count,
  cast(sum(invoice_amount) as double) as invoice_amount
from assessed where is_open = 1 and days_overdue > 0 group by 1""", CUSTOMERS, _LOW),
    "top_customers": _from("""
select customer_id, customer_name, risk_level, risk_score, risk_confidence, open_amount, open_invoice_count,
  late_payment_rate, average_payment_delay
from scored order by risk_score desc, open_amount desc, customer_id limit 20""", CUSTOMERS, _LOW),
}
