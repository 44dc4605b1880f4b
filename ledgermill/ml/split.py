"""Train/test split by company: exact share of companies, decided row by row.

Companies are ordered by a seeded SHA-256 and the first share of them is the test set. Only the
position where the share ends is looked up; each row then compares its own hash with it, so
the rows are neither joined nor shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_DIGITS = 3  # of the hash: 4096 buckets


@dataclass(frozen=True)
class CompanyCut:
    """The last company of the test set in hash order."""

    group: str
    seed: int
    bucket: str
    hash: str
    company: str | None

    def in_test(self) -> Column:
        bucket, code = _bucket(self.group, self.seed), _hash(self.group, self.seed)
        if self.company is None:
            return F.lit(False)
        until = (code < self.hash) | ((code == self.hash) & (F.col(self.group) <= self.company))
        return (bucket < self.bucket) | ((bucket == self.bucket) & until)


def _hash(group: str, seed: int) -> Column:
    """The SHA-256 of seed and company in hex: a fixed order that other engines can repeat."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group)), 256)


def _bucket(group: str, seed: int) -> Column:
    return F.substring(_hash(group, seed), 1, BUCKET_DIGITS)


def company_cut(rows: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> CompanyCut:
    """Where the test companies end.

    Counts per hash bucket (at most 4096 rows) come to the driver; only the companies of one
    bucket are then ordered.
    """
    companies = rows.filter(F.col(group).isNotNull()).select(group).distinct()
    counts = dict(companies.groupBy(_bucket(group, seed).alias("b")).count().collect())
    left = math.ceil(test_share * sum(counts.values()))
    for bucket in sorted(counts):
        if left <= counts[bucket]:
            break
        left -= counts[bucket]
    else:
        return CompanyCut(group, seed, "", "", None)
    last = (
        companies.filter(_bucket(group, seed) == bucket)
        .select(_hash(group, seed).alias("h"), group)
        .orderBy("h", group)
        .offset(max(left - 1, 0))
        .limit(1)
        .first()
    )
    return CompanyCut(group, seed, bucket, last["h"], last[group])


def split_by_company(
    rows: DataFrame, group: str, test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with no company on both sides."""
    in_test = company_cut(rows, group, test_share, seed).in_test()
    known = rows.filter(F.col(group).isNotNull())
    return known.filter(~in_test), known.filter(in_test)


def split_summary(rows: DataFrame, train: DataFrame, test: DataFrame, group: str, target: str) -> DataFrame:
    """Row counts, label balance, companies per side and their overlap, in one row."""
    train_ids, test_ids = (side.select(group).distinct() for side in (train, test))
    overlap = train_ids.intersect(test_ids)

    def size(ids: DataFrame) -> Column:
        return ids.agg(F.count("*").alias("n")).scalar()

    positives = F.count_if(F.col(target) == 1)
    return rows.agg(
        F.count("*").alias("rows_used"),
        positives.alias("positive_label_count"),
        F.count_if(F.col(target) == 0).alias("negative_label_count"),
        F.round(F.try_divide(positives.cast("double"), F.count("*").cast("double")), 4).alias(
            "positive_label_rate"
        ),
    ).withColumns(
        {
            "train_companies": size(train_ids),
            "test_companies": size(test_ids),
            "group_overlap": size(overlap),
        }
    )
