"""Stored tables as Parquet snapshots.

A new snapshot is written next to the old one and becomes current when its write commits, so
readers and restarted jobs never see half a table; snapshots older than the last RETAIN expire.
Append-only tables get one folder per run that a repeated run overwrites instead of adding to.

Keyed tables are stored in PARTS partitions by a hash of their key (column ``_part``). A merge
rewrites only the partitions its changes touch: it reads those partitions alone, writes the
merged rows to a staging folder, and puts them in place by dynamic partition overwrite. Until
that commit the table is untouched, and merges are idempotent, so a failed step is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from . import files

SCHEMAS: dict[str, T.StructType] = {
    "invoices": schemas.INVOICES,
    "customers": schemas.CUSTOMERS,
    "assessments": schemas.ASSESSMENTS,
    "actions": schemas.ACTIONS,
    "audit": schemas.AUDIT,
    "import_jobs": schemas.IMPORT_JOBS,
    "rejects": schemas.REJECTS,
}

#: Keyed tables and their keys; these are stored in partitions by a hash of the key.
KEYS = {"invoices": "invoice_id", "customers": "customer_id"}
#: Partitions of a keyed table: a one-key change rewrites 1/PARTS of it.
PARTS = 64
#: Snapshots kept of each table; older ones are deleted after a new one commits.
RETAIN = 2
PART = "_part"


def part_of(key: str) -> Column:
    """The partition of a key's rows."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PARTS)).cast("int")


def _by_part(df: DataFrame) -> DataFrame:
    """Rows dealt by partition, so that a partition has one file or, when large, a few: without
    this every task writes a file into each partition. Adaptive execution splits large ones."""
    return df.hint("rebalance", F.col(PART))


class TableStore:
    """Named tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> list[int]:
        found = []
        for child in files.child_names(self.spark, self.path(name)):
            if child.startswith("v") and child[1:].isdigit():
                if files.exists(self.spark, f"{self.path(name)}/{child}/_SUCCESS"):
                    found.append(int(child[1:]))
        return sorted(found)

    def _next(self, name: str) -> int:
        taken = [int(c[1:]) for c in files.child_names(self.spark, self.path(name)) if c[1:].isdigit()]
        return max(taken, default=0) + 1

    def current(self, name: str) -> DataFrame | None:
        """The latest snapshot with all its columns, or None before the first."""
        versions = self._versions(name)
        if not versions:
            return None
        where = f"{self.path(name)}/v{versions[-1]:06d}"
        if name in KEYS and not any(c.startswith(f"{PART}=") for c in files.child_names(self.spark, where)):
            return self.spark.createDataFrame([], SCHEMAS[name])  # an empty keyed table has no files
        return self.spark.read.parquet(where).drop(PART)

    def read(self, name: str) -> DataFrame:
        """The latest snapshot in the table's columns; empty before the first."""
        found = self.current(name)
        if found is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return schemas.conform(found, SCHEMAS[name])

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new snapshot and return it as stored, extra columns included."""
        # The number is claimed by an exclusive create, so two writers can't take the same one.
        number = self._next(name)
        while not files.claim(self.spark, f"{self.path(name)}/_claim-{number:06d}"):
            number += 1
        where = f"{self.path(name)}/v{number:06d}"
        if name in KEYS:
            _by_part(df.withColumn(PART, part_of(KEYS[name]))).write.mode("overwrite").partitionBy(PART).parquet(where)
        else:
            df.write.mode("overwrite").parquet(where)
        self._expire(name)
        if name in KEYS:
            stored = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType())])
            return self.spark.read.schema(stored).parquet(where).drop(PART)
        return self.spark.read.parquet(where)

    def _expire(self, name: str) -> None:
        """Delete snapshots older than the last RETAIN committed ones."""
        for number in self._versions(name)[:-RETAIN]:
            files.delete(self.spark, f"{self.path(name)}/v{number:06d}")

    def merge(self, name: str, keys: DataFrame, merged: Callable[[DataFrame], DataFrame], run: str) -> DataFrame:
        """Rewrite only the partitions of a keyed table that hold ``keys``; returns the rows written.

        ``merged`` turns the current rows of those partitions (in the table's columns) into
        their new rows, e.g. an upsert of changes; rows of other partitions stay as stored.
        Before the first snapshot the merge writes one. The partitions touched are at most
        PARTS numbers on the driver.
        """
        key = KEYS[name]
        versions = self._versions(name)
        if not versions:
            return self.replace(name, merged(self.read(name)))
        where = f"{self.path(name)}/v{versions[-1]:06d}"
        touched = sorted(r[0] for r in keys.select(part_of(key).alias(PART)).distinct().collect())
        if not touched:
            return merged(self.read(name)).limit(0)
        current = schemas.conform(self.spark.read.parquet(where).filter(F.col(PART).isin(touched)), SCHEMAS[name])
        out = merged(current).withColumn(PART, part_of(key))
        staged = self.staging(f"merge-{name}", run)
        out.write.mode("overwrite").parquet(staged)
        written = self.spark.read.parquet(staged)
        _by_part(written).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(where)
        return self.spark.read.parquet(staged).drop(PART)

    def append(self, name: str, df: DataFrame, run: str) -> DataFrame:
        """Add one run's rows and return them as stored; repeating the run replaces them."""
        where = f"{self.path(name)}/run={run}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def read_appended(self, name: str) -> DataFrame:
        if not any(c.startswith("run=") for c in files.child_names(self.spark, self.path(name))):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return schemas.conform(self.spark.read.parquet(self.path(name)), SCHEMAS[name])

    def staging(self, label: str, run: str) -> str:
        """Where a run keeps an intermediate result."""
        return f"{self.root}/_staging/{run}/{label}"

    def clear_staging(self, run: str) -> None:
        """Drop a finished run's intermediate results."""
        files.delete(self.spark, f"{self.root}/_staging/{run}")

    def stage(self, df: DataFrame, label: str, run: str) -> DataFrame:
        """A written intermediate result: read many times, computed once."""
        where = self.staging(label, run)
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.parquet(where)
