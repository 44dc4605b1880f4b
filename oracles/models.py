"""DuckDB SQL for the model metric queries."""

from __future__ import annotations

from ledgermill.sources import sample_tables as samples

from .enrichment import TABLES

_RATES = """
  cast(printf('%.4f', case when tp + fp = 0 then 0 else tp::double / (tp + fp) end) as double) as precision,
  cast(printf('%.4f', case when tp + fn = 0 then 0 else tp::double / (tp + fn) end) as double) as recall,
  cast(printf('%.4f', case when 2 * tp + fp + fn = 0 then 0 else (2 * tp)::double / (2 * tp + fp + fn) end) as double)
    as f1,
  tp as true_positive, fp as false_positive, tn as true_negative, fn as false_negative"""


def _counts(test):
    return (f"count(*) filter ({test} and label = 1) as tp, count(*) filter ({test} and label = 0) as fp,"
            f" count(*) filter (not ({test}) and label = 0) as tn, count(*) filter (not ({test}) and label = 1) as fn")


def _report(grid, by=""):
    key = f"{by}, " if by else ""
    return f"""
select {key}threshold, {_RATES} from (
  select {key}threshold, {_counts('score >= threshold')}
  from scored, (select unnest([{', '.join(str(t) for t in grid)}])::double as threshold) as t
  group by all) as c"""


_GRID = [round(n / 100, 2) for n in range(20, 81, 5)]
_WIDE_GRID = [round(n / 100, 2) for n in range(20, 91, 5)]


def _best(report, floor):
    return f"""
select model_number, threshold as selected_threshold,
  case when recall >= {floor} then 'max_f1_with_recall_floor_{floor}' else 'max_f1_no_recall_floor_match' end
    as strategy,
  {floor}::double as recall_floor, precision, recall, f1, true_positive, false_positive, true_negative, false_negative
from ({report}) as r
qualify row_number() over (partition by model_number
  order by (recall >= {floor}) desc, f1 desc, recall desc, threshold desc) = 1"""


_BASE = {
    "scored": samples.duckdb_text(samples.SCORED_ROWS),
    "by_model": _report(_WIDE_GRID, "model_number"),
    "best": _best("select * from by_model", 0.8),
    "ranked": """
select model_number, cast(printf('%.4f', sum(n * (2 * (cp - p) + p))::double / (2 * sum(p)::double * sum(n)::double)) as double)
    as roc_auc,
  cast(printf('%.4f', sum(p::double * (cp::double / (cp + cn)::double)) / sum(p)::double) as double) as pr_auc
from (
  select model_number, p, n, sum(p) over w as cp, sum(n) over w as cn
  from (select model_number, score, sum(label) as p, sum(1 - label) as n from scored group by model_number, score) as g
  window w as (partition by model_number order by score desc rows unbounded preceding)) as c
group by model_number""",
    "results": """
select case when model_number = 3 then 'logistic_regression_balanced' else 'model_' || model_number end as model_name,
  case when model_number = 7 then 'skipped' else 'trained' end as status, precision, recall, f1,
  roc_auc, case when model_number <> 2 then pr_auc end as pr_auc,
  cast(null as double) as brier_score, selected_threshold
from best join ranked using (model_number)""",
}
_WITH = "with " + ",\n".join(f"{n} as ({t})" for n, t in _BASE.items()) + "\n"
_PUB = "with " + ",\n".join(f"{n} as ({t})" for n, t in TABLES.items()) + "\n"

# The split, written out: companies in the order of the SHA-256 of "42:" and number.
_SPLIT = """,
usable as (select * from flagged where not is_rejected and company_number is not null and slow_payer_label is not null),
ordered as (
  select company_number, row_number() over (order by sha256('42:' || company_number), company_number) as place,
    count(*) over () as n
  from (select distinct company_number from usable) as c),
sides as (
  select u.*, case when place <= ceil(0.2::double * n) then 'test' else 'train' end as side
  from usable as u join ordered using (company_number))
"""

_NUMERIC = [
    "pct_paid_within_30",
    "pct_paid_31_60",
    "pct_paid_later_60",
    "pct_not_paid_within_terms",
    "pct_not_paid_due_to_dispute",
    "shortest_standard_payment_period",
    "longest_standard_payment_period",
    "maximum_contractual_payment_period",
    "company_reporting_count",
    "payment_terms_changed_covid_related",
    "payment_terms_changed_policy_related",
    "payment_terms_changed_supplier_related",
]
_CATEGORIES = [
    "payment_terms_changed_flag",
    "e_invoicing_offered",
    "supply_chain_financing_offered",
    "participates_in_payment_codes",
]


def _number_fill(name: str) -> str:
    """The lower median of a feature's values and the mean once it fills the gaps."""
    return f"""
select '{name}' as feature, m as median,
  (select round(avg(coalesce(cast({name} as double), m)), 6) from sides where side = 'train') as mean,
  cast(null as varchar) as mode
from (select quantile_disc(cast({name} as double), 0.5) as m from sides where side = 'train') as q"""


def _text_fill(name: str) -> str:
    return f"""
select '{name}', null, null,
  (select v from (select cast({name} as varchar) as v, count(*) as n from sides
     where side = 'train' and {name} is not null group by 1) as c order by n desc, v limit 1)"""



_GIVEN = [("pct_paid_within_30", -0.04), ("pct_paid_later_60", 0.05), ("pct_not_paid_within_terms", 0.03),
          ("shortest_standard_payment_period", 0.01)]


def _driver_bands() -> str:
    """Band, label and the strongest drivers under given coefficients, counted by combination."""
    value = [f"coalesce(cast({n} as double), 0)" for n, _ in _GIVEN]
    parts = [f"round_even({v} * {c}, 6)" for v, (_, c) in zip(value, _GIVEN)]
    up = ", ".join(f"{{'k': -{p}, 'p': {i}, 'n': '{n}'}}" for i, (p, (n, _)) in enumerate(zip(parts, _GIVEN)))
    down = ", ".join(f"{{'k': {p}, 'p': {i}, 'n': '{n}'}}" for i, (p, (n, _)) in enumerate(zip(parts, _GIVEN)))
    logit = " + ".join(f"{v} * {c}" for v, (_, c) in zip(value, _GIVEN))
    return _PUB + f"""
select top_up, top_down, case when p >= 0.5 then 'High' when p >= 0.3 then 'Medium' else 'Low' end as risk_band,
  (p >= 0.5)::integer as predicted_label, count(*) as rows
from (select coalesce(list_sort(list_filter([{up}], lambda e: e.k < 0))[1].n, '') as top_up,
        coalesce(list_sort(list_filter([{down}], lambda e: e.k < 0))[1].n, '') as top_down,
        1.0 / (1.0 + exp(-(-1.5 + {logit}))) as p
      from flagged where not is_rejected) as x
group by all"""


ORACLES = {
    "thresholds": _WITH + _report(_GRID),
    "thresholds_by_model": _WITH + "select * from by_model",
    "best_threshold": _WITH + "select * from best",
    "best_threshold_high_floor": _WITH + _best(
        "select * from by_model", 1.01),
    "default_metrics": _WITH + f"""
select cast(printf('%.4f', (tp + tn)::double / (tp + fp + tn + fn)) as double) as accuracy, {_RATES},
  cast(printf('%.6f', brier) as double) as brier_score
from (select {_counts('score > 0.5')}, avg((score - label) * (score - label)) as brier from scored) as c""",
    "ranking": _WITH + """
select cast(printf('%.4f', sum(n * (2 * (cp - p) + p))::double / (2 * sum(p)::double * sum(n)::double)) as double)
    as roc_auc,
  cast(printf('%.4f', sum(p::double * (cp::double / (cp + cn)::double)) / sum(p)::double) as double) as pr_auc
from (
  select p, n, sum(p) over w as cp, sum(n) over w as cn
  from (select score, sum(label) as p, sum(1 - label) as n from scored group by score) as g
  window w as (order by score desc rows unbounded preceding)) as c""",
    "calibration": _WITH + """
select cast(bin as integer) as bin, cast(printf('%.6f', avg(score)) as double) as mean_predicted_probability,
  cast(printf('%.6f', avg(label::double)) as double) as observed_positive_rate
from (select *, """ + " + ".join(f"(score > {n}::double * 0.1::double)::int" for n in range(1, 10)) + """ as bin from scored) as b
group by bin""",
    "brier": _WITH + """
select cast(printf('%.6f', avg((score - label) * (score - label))) as double) as brier_score from scored""",
    "model_select": _WITH + """
select case when b.model_name is null or w.model_name = b.model_name or w.f1 >= b.f1 + 0.02::double
    then w.model_name else b.model_name end as selected_model,
  case when b.model_name is null then 'baseline_missing_selected_best_available_model'
    when w.model_name = b.model_name then 'baseline_logistic_regression_won_selection_rule'
    when w.f1 >= b.f1 + 0.02::double then 'replacement_model_met_minimum_f1_improvement'
    else 'kept_logistic_regression_due_to_insufficient_improvement' end as selection_reason,
  case when w.recall >= 0.8 then 'recall_at_least_0.8' else 'no_model_met_recall_floor' end as selection_pool,
  0.8::double as recall_floor, 0.02::double as min_f1_improvement_required,
  f.precision, f.recall, f.f1, f.roc_auc, f.pr_auc, f.brier_score, f.selected_threshold
from (select * from results where status = 'trained' order by (recall >= 0.8) desc, f1 desc, precision desc,
        pr_auc desc nulls last, model_name limit 1) as w
left join (select * from results where status = 'trained' and model_name = 'logistic_regression_balanced') as b on true
join results as f on f.model_name = case when b.model_name is null or w.model_name = b.model_name
  or w.f1 >= b.f1 + 0.02::double then w.model_name else b.model_name end""",
    "model_best_baseline": _WITH + """
select model_name, f1, roc_auc from results order by f1 desc, roc_auc desc, model_name limit 1""",
    "linear_driver_bands": _driver_bands(),
    "majority_baseline": _PUB + _SPLIT + f""",
share as (select count(*) filter (slow_payer_label = 1)::double / greatest(count(*), 1) as s from sides where side = 'train'),
scored as (select slow_payer_label as label, case when (select s from share) > 0.5 then 1.0 else 0.0 end as score
           from sides where side = 'test')
select cast(printf('%.4f', (tp + tn)::double / (tp + fp + tn + fn)) as double) as accuracy, {_RATES},
  cast(printf('%.6f', brier) as double) as brier_score
from (select {_counts('score > 0.5')}, avg((score - label) * (score - label)) as brier from scored) as c""",
    "score_bands": _WITH + """
select case when score >= 0.6 then 'High' when score >= 0.3 then 'Medium' else 'Low' end as risk_band,
  count(*) as rows, cast(sum(label) as bigint) as positives from scored group by 1""",
    "split_members": _PUB + _SPLIT + """
select company_number, side, count(*) as rows from sides group by company_number, side""",
    "fill_values": _PUB + _SPLIT + " union all ".join(
        [_number_fill(n) for n in _NUMERIC] + [_text_fill(n) for n in _CATEGORIES]),
    "class_weights": _PUB + _SPLIT + """
select slow_payer_label, count(*) as rows,
  round((select count(*) from sides where side = 'train')::double / (2::double * count(*)), 9) as weight
from sides where side = 'train' group by slow_payer_label""",
    "train_split": _PUB + _SPLIT + """
select count(*) as rows_used, count(*) filter (slow_payer_label = 1) as positive_label_count,
  count(*) filter (slow_payer_label = 0) as negative_label_count,
  round(count(*) filter (slow_payer_label = 1)::double / count(*), 4) as positive_label_rate,
  count(distinct company_number) filter (side = 'train') as train_companies,
  count(distinct company_number) filter (side = 'test') as test_companies,
  (select count(*) from (select company_number from sides group by company_number having count(distinct side) > 1) as o)
    as group_overlap
from sides""",
}
