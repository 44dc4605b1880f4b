"""Helpers the training-data operators share: tables, staged results, word columns."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

# The two word definitions, as Java regular expressions. The second is the class
# [^\x00-\x2F\x3A-\x60\x7B-\x7F] of a text whose A-Z are not yet lower-cased, written as what
# it holds: Java tests that in less than half the time.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
# ASCII characters outside PLAIN_WORD.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


# Rows of whole texts that travel to a Python worker at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in smaller batches than Spark's 10,000 rows.

    Jobs on whole documents call this once: both the executor and its workers hold a batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, to be sent on in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result once and read it back; lost executors don't lose it."""
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; null has none.

    One character table lower-cases and turns separators into spaces, and splitting at a single
    space needs no regular expression.
    """
    plain = F.translate(
        F.coalesce(text, F.lit("")),
        SEPARATORS + string.ascii_uppercase,
        " " * len(SEPARATORS) + string.ascii_lowercase,
    )
    return F.array_remove(F.split(plain, " "), "")


def plain_word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PLAIN_WORD)).cast("long")


def spaced_word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("long")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, so that later filters don't compute them again."""
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_settled")).select(
        *df.columns, *[F.col(f"_settled.{name}").alias(name) for name in columns]
    )


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for a job's own columns that clash with none of ``df``'s, compared as Spark does
    (without case): each name gets underscores in front until it is free."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
