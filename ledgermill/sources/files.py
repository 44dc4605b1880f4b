"""File-system helpers through Hadoop, so local, HDFS and object-store paths all work."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, where = _fs(spark, path)
    return int(fs.getContentSummary(where).getLength())


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(where))


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it exists; only one of several callers succeeds."""
    fs, where = _fs(spark, path)
    return fs.createNewFile(where)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a job's own work folder."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def write_json(spark: SparkSession, data: dict | list, path: str) -> str:
    """A small record as one JSON line under a path."""
    spark.createDataFrame([(json.dumps(data, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)
    return path


def read_json(spark: SparkSession, path: str):
    """A small JSON record: what ``write_json`` wrote, or any one JSON file."""
    return json.loads("\n".join(row["value"] for row in spark.read.text(path, wholetext=True).collect()))


def write_table(df: DataFrame, path: str, file_format: str = "parquet") -> str:
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(file_format).save(path)
    return path
