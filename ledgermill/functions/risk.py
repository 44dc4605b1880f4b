"""Rule scoring as column expressions: tiers, levels, reasons and suggested actions.

Settings are plain numbers, so every threshold and weight is folded into the plan as a
literal and scoring stays one projection without Python workers.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import first_match
from .numbers import fixed_text
from .text import fill, strip

# Default thresholds and weights of the rules.
DEFAULT_SETTINGS = {
    "medium_risk_threshold": 40,
    "high_risk_threshold": 70,
    "customer_late_payment_high_rate": 50,
    "customer_late_payment_medium_rate": 30,
    "customer_late_payment_high_weight": 25,
    "customer_late_payment_medium_weight": 15,
    "customer_average_delay_high_days": 15,
    "customer_average_delay_medium_days": 7,
    "customer_average_delay_low_days": 3,
    "customer_average_delay_high_weight": 20,
    "customer_average_delay_medium_weight": 12,
    "customer_average_delay_low_weight": 5,
    "customer_open_invoice_high_count": 10,
    "customer_open_invoice_medium_count": 3,
    "customer_open_invoice_low_count": 1,
    "customer_open_invoice_high_weight": 15,
    "customer_open_invoice_medium_weight": 10,
    "customer_open_invoice_low_weight": 5,
    "customer_open_amount_high_multiplier": 5,
    "customer_open_amount_medium_multiplier": 3,
    "customer_open_amount_low_multiplier": 1.5,
    "customer_open_amount_high_weight": 20,
    "customer_open_amount_medium_weight": 15,
    "customer_open_amount_low_weight": 10,
    "customer_limited_history_closed_invoice_count": 3,
    "customer_limited_history_payment_behavior_cap": 25,
    "customer_no_closed_invoice_weight": 10,
    "invoice_overdue_high_days": 60,
    "invoice_overdue_medium_days": 30,
    "invoice_overdue_low_days": 15,
    "invoice_overdue_any_weight": 8,
    "invoice_overdue_high_weight": 35,
    "invoice_overdue_medium_weight": 25,
    "invoice_overdue_low_weight": 15,
    "invoice_customer_high_risk_weight": 30,
    "invoice_customer_medium_risk_weight": 15,
    "invoice_amount_high_multiplier": 5,
    "invoice_amount_medium_multiplier": 3,
    "invoice_amount_low_multiplier": 1.5,
    "invoice_amount_high_weight": 20,
    "invoice_amount_medium_weight": 15,
    "invoice_amount_low_weight": 10,
}
LEVELS = ("Low", "Medium", "High")
HIGH_CONFIDENCE_CLOSED = 10
MEDIUM_CONFIDENCE_CLOSED = 3

# The sentences of the explanations.
LATE_HIGH = "Late payment rate is high at {value}%, adding {weight} points."
LATE_MEDIUM = "Late payment rate is elevated at {value}%, adding {weight} points."
DELAY_HIGH = "Average payment delay is high at {value} days, adding {weight} points."
DELAY_MEDIUM = "Average payment delay is elevated at {value} days, adding {weight} points."
DELAY_LOW = "Average payment delay is slightly elevated at {value} days, adding {weight} points."
LIMITED_HISTORY = (
    "Payment history is limited, so confidence is low and payment behavior risk is capped "
    "at {cap} points."
)
OPEN_MANY = "Customer has {value} open invoices, adding {weight} points."
OPEN_ONE = "Customer has {value} open invoice, adding {weight} points."
OPEN_AMOUNT = (
    "Open amount is more than {times} times the customer's average invoice amount, "
    "adding {weight} points."
)
NO_CLOSED = "Customer has no closed invoice history, adding {weight} points."
OVERDUE = "Invoice is {value} days overdue, adding {weight} points."
CUSTOMER_LEVEL = "Customer risk level is {level}, adding {weight} points."
INVOICE_AMOUNT = (
    "Invoice amount is more than {times} times the customer's average invoice amount, "
    "adding {weight} points."
)
CUSTOMER_END = "Final classification: {level} risk."
CUSTOMER_NONE = "No risk rules were triggered. Customer is classified as {level} risk."
INVOICE_END = "Final classification: {level} risk. Suggested action: {action}."
INVOICE_NONE = (
    "No invoice risk rules were triggered. Invoice is classified as {level} risk. "
    "Suggested action: {action}."
)
MULTIPLIER_WORDS = {5: "five", 3: "three"}
ESCALATE = "Escalate Collection"
FOLLOW_UP = "Immediate Follow-up"
REMIND = "Send Reminder"
MONITOR = "Monitor"


def number_setting(value, missing: float = 0.0) -> float:
    """A setting as a number; missing or unreadable values fall back."""
    try:
        return float(value) if value not in (None, "") else missing
    except (TypeError, ValueError):
        return missing


def scoring_settings(overrides: Mapping | None = None) -> dict[str, float]:
    """Defaults with known keys replaced by the given numbers; unknown keys are ignored."""
    merged = {key: float(value) for key, value in DEFAULT_SETTINGS.items()}
    merged.update({k: number_setting(v) for k, v in (overrides or {}).items() if k in merged})
    return merged


@dataclass(frozen=True)
class Rule:
    """One scoring rule: points to add and the sentence that explains them."""

    points: Column
    reason: Column


def _tiers(rows: list[tuple[Column, float, Column]]) -> Rule:
    """First tier whose condition holds; no tier adds nothing and says nothing."""
    return Rule(
        points=first_match([(test, float(weight)) for test, weight, _ in rows], 0.0),
        reason=first_match([(test, text) for test, _, text in rows]),
    )


def _times(multiplier: float) -> str:
    return MULTIPLIER_WORDS.get(multiplier, f"{multiplier:.1f}")


def _number(value: Column | str) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.cast("double"), F.lit(0.0))


def level_for(score: Column, settings: Mapping[str, float]) -> Column:
    """High / Medium / Low of a score bounded to 0..100."""
    bounded = F.least(F.greatest(_number(score), F.lit(0.0)), F.lit(100.0))
    return first_match(
        [
            (bounded >= settings["high_risk_threshold"], "High"),
            (bounded >= settings["medium_risk_threshold"], "Medium"),
        ],
        "Low",
    )


def confidence_for(closed: Column) -> Column:
    return first_match(
        [
            (_number(closed) >= HIGH_CONFIDENCE_CLOSED, "High"),
            (_number(closed) >= MEDIUM_CONFIDENCE_CLOSED, "Medium"),
        ],
        "Low",
    )


def action_for(level: Column, days_overdue: Column, settings: Mapping[str, float]) -> Column:
    late = _number(days_overdue) > settings["invoice_overdue_medium_days"]
    return first_match(
        [
            ((level == "High") & late, ESCALATE),
            (level == "High", FOLLOW_UP),
            (level == "Medium", REMIND),
        ],
        MONITOR,
    )


def average_amount(total: Column, invoices: Column) -> Column:
    """Average invoice amount, 0 without invoices."""
    count = _number(invoices)
    return F.when(count > 0, _number(total) / count).otherwise(F.lit(0.0))


def _whole_score(points: Column) -> Column:
    return F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0)).cast("int")


def _sentences(reasons: list[Column], end: Column, none: Column) -> Column:
    said = F.concat_ws(" ", *reasons)
    return F.when(said == "", none).otherwise(F.concat_ws(" ", said, end))


def _amount_tiers(amount: Column, average: Column, prefix: str, text: str, s: Mapping) -> Rule:
    rows = []
    for size in ("high", "medium", "low"):
        times = s[f"{prefix}_{size}_multiplier"]
        weight = s[f"{prefix}_{size}_weight"]
        sentence = fill(text, {"times": _times(times), "weight": int(weight)})
        rows.append(((average > 0) & (amount > average * times), weight, sentence))
    return _tiers(rows)


def customer_rules(settings: Mapping[str, float], average: Column) -> dict[str, Rule]:
    """The customer rules over the metric columns and the average invoice amount."""
    s = settings
    rate, delay = _number("late_payment_rate"), _number("average_payment_delay")
    closed, opened = _number("closed_invoice_count"), _number("open_invoice_count")

    def tier(test, weight, text, value):
        return test, weight, fill(text, {"value": value, "weight": int(weight)})

    rate_text, delay_text = fixed_text(rate, 1), fixed_text(delay, 1)
    open_text = opened.cast("bigint").cast("string")
    late_high = s["customer_late_payment_high_weight"]
    late_medium = s["customer_late_payment_medium_weight"]
    limited = closed < s["customer_limited_history_closed_invoice_count"]
    cap = s["customer_limited_history_payment_behavior_cap"]
    none_closed = s["customer_no_closed_invoice_weight"]
    return {
        "late": _tiers(
            [
                tier(rate > s["customer_late_payment_high_rate"], late_high, LATE_HIGH, rate_text),
                tier(rate > s["customer_late_payment_medium_rate"], late_medium, LATE_MEDIUM, rate_text),
            ]
        ),
        "delay": _tiers(
            [
                tier(
                    delay > s[f"customer_average_delay_{size}_days"],
                    s[f"customer_average_delay_{size}_weight"],
                    text,
                    delay_text,
                )
                for size, text in (("high", DELAY_HIGH), ("medium", DELAY_MEDIUM), ("low", DELAY_LOW))
            ]
        ),
        # The cap is applied to the points above; its sentence shows for every short history.
        "limited": Rule(
            points=F.when(limited, F.lit(float(cap))),
            reason=F.when(limited, fill(LIMITED_HISTORY, {"cap": int(cap)})),
        ),
        "open_count": _tiers(
            [
                tier(
                    opened >= s[f"customer_open_invoice_{size}_count"],
                    s[f"customer_open_invoice_{size}_weight"],
                    text,
                    open_text,
                )
                for size, text in (("high", OPEN_MANY), ("medium", OPEN_MANY), ("low", OPEN_ONE))
            ]
        ),
        "open_amount": _amount_tiers(
            _number("open_amount"), average, "customer_open_amount", OPEN_AMOUNT, s
        ),
        "no_closed": _tiers([(closed == 0, none_closed, fill(NO_CLOSED, {"weight": int(none_closed)}))]),
    }


def customer_score(rules: Mapping[str, Rule]) -> Column:
    behavior = rules["late"].points + rules["delay"].points
    # least() skips the NULL cap of customers with enough history.
    behavior = F.least(behavior, rules["limited"].points)
    exposure = rules["open_count"].points + rules["open_amount"].points
    return _whole_score(behavior + exposure + rules["no_closed"].points)


def customer_explanation(rules: Mapping[str, Rule], level: Column) -> Column:
    return _sentences(
        [rule.reason for rule in rules.values()],
        fill(CUSTOMER_END, {"level": level}),
        fill(CUSTOMER_NONE, {"level": level}),
    )


def invoice_rules(settings: Mapping[str, float]) -> list[Rule]:
    """The invoice rules over days_overdue, invoice_amount, average_invoice_amount and
    customer_risk_level."""
    s = settings
    days = _number("days_overdue")
    amount, average = _number("invoice_amount"), _number("average_invoice_amount")
    customer_level = strip(F.coalesce(F.col("customer_risk_level"), F.lit("")))
    days_text = fixed_text(days, 1)

    def overdue(limit, weight):
        return days > limit, weight, fill(OVERDUE, {"value": days_text, "weight": int(weight)})

    def customer(level, weight):
        return customer_level == level, weight, fill(CUSTOMER_LEVEL, {"level": level, "weight": int(weight)})

    return [
        _tiers(
            [
                overdue(s["invoice_overdue_high_days"], s["invoice_overdue_high_weight"]),
                overdue(s["invoice_overdue_medium_days"], s["invoice_overdue_medium_weight"]),
                overdue(s["invoice_overdue_low_days"], s["invoice_overdue_low_weight"]),
                overdue(0, s["invoice_overdue_any_weight"]),
            ]
        ),
        _tiers(
            [
                customer("High", s["invoice_customer_high_risk_weight"]),
                customer("Medium", s["invoice_customer_medium_risk_weight"]),
                customer("Low", 0),
            ]
        ),
        _amount_tiers(amount, average, "invoice_amount", INVOICE_AMOUNT, s),
    ]


def invoice_score(rules: list[Rule]) -> Column:
    return _whole_score(sum((rule.points for rule in rules[1:]), rules[0].points))


def invoice_explanation(rules: list[Rule], level: Column, action: Column) -> Column:
    ends = {"level": level, "action": action}
    return _sentences(
        [rule.reason for rule in rules], fill(INVOICE_END, ends), fill(INVOICE_NONE, ends)
    )
