"""Small DataFrame helpers used by several operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A few fixed rows as a DataFrame that the optimizer folds to a local relation."""
    structs = [
        F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def reject_rows(df: DataFrame, stage: str, key: str, messages: str) -> DataFrame:
    """Rejected rows in the form of the rejects table but for the run; the row is kept as JSON."""
    fields = [name for name in df.columns if name != messages]
    return df.select(
        F.lit(stage).alias("stage"),
        F.col(key).cast("string").alias("row_key"),
        F.to_json(F.struct(*fields)).alias("row_text"),
        F.col(messages).alias("messages"),
    )


def unpivot_metrics(one_row: DataFrame, names: Sequence[str]) -> DataFrame:
    """A one-row DataFrame of counts as (metric, value) rows."""
    pairs = [
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("bigint").alias("value"))
        for name in names
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Keep the named computed columns from being computed again by filters placed on them.

    The optimizer copies the expression behind a column into every filter it pushes below the
    projection. Long parsing expressions would then run twice and outgrow one compiled method.
    A one-row generator ends that: filters on its output stay above it.
    """
    kept = [name for name in df.columns if name not in names]
    out = df.select(*kept, F.inline(F.array(F.struct(*names))))
    return out.select(*df.columns)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    An aggregate joined back to the rows it came from is already dealt by the join key, so the
    join shuffles only the rows, and adaptive execution cannot split a key that holds most of
    them. Read back from storage, both sides are shuffled for the join and a dominant key is split.
    """
    from ..session import shared_folder

    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """``df`` with ``name``, the place (from 1) of each row in ``order``, which should be total.

    Rows are dealt into ranges of the order (a range shuffle) and written once, so the ranges
    stay as they were cut when a task is run again. Each range counts its rows; the counts of
    earlier ranges (one row per range) are summed into offsets, and rows are numbered inside
    their range: no window holds all rows, and no task more than one range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    from pyspark.sql import Window

    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    offsets = counts.select(
        "_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(offsets, "_range").withColumn(name, F.col("_offset") + F.row_number().over(inside)).drop("_range", "_offset")
