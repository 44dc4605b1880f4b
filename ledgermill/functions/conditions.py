"""Condition chains and message lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def first_match(rules: Sequence[tuple[Column, Column | str | float]], otherwise=None) -> Column:
    """The value of the first rule whose condition is true."""
    (condition, value), *rest = rules
    chain = F.when(condition, value if isinstance(value, Column) else F.lit(value))
    for condition, value in rest:
        chain = chain.when(condition, value if isinstance(value, Column) else F.lit(value))
    if otherwise is None:
        return chain
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def messages(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """All messages whose condition is true, in rule order, as an array."""
    found = [
        F.when(condition, text if isinstance(text, Column) else F.lit(text))
        for condition, text in rules
    ]
    return F.array_compact(F.array(*found))
