"""Company fact documents: one JSON file, a directory tree, or a ZIP archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import is_directory

_MEMBERS = "name string, value string"


def _zip_members(archives: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per JSON member; members are read one at a time."""
    for batch in archives:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in sorted(n for n in archive.namelist() if n.lower().endswith(".json")):
                    text = archive.read(member).decode("utf-8")
                    yield pd.DataFrame({"name": [f"{path}#{member}"], "value": [text]})


def read_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Document texts as (name, value); ``limit`` keeps the first names in order.

    A directory is read file by file over all executors. A ZIP cannot be split, so a large
    archive is better unpacked first.
    """
    kind = str(path).lower()
    if kind.endswith(".zip"):
        archives = spark.read.format("binaryFile").load(path).select("path", "content")
        documents = archives.mapInPandas(_zip_members, _MEMBERS)
    elif kind.endswith(".json") or is_directory(spark, path):
        reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        if not kind.endswith(".json"):
            reader = reader.option("pathGlobFilter", "*.json")
        documents = reader.text(path).select(F.col("_metadata.file_path").alias("name"), "value")
    else:
        raise ValueError(f"Unsupported input path: {path}. Use a .json file, .zip archive, or directory.")
    if limit is None:
        return documents
    first = documents.select("name").orderBy("name").limit(int(limit))
    return documents.join(first, "name", "left_semi")
