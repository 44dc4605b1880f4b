"""CSV scans. Every field is read as text; typing is the operators' job."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ml.columns import GROUP
from ..operators.validation import FIRST_DATA_LINE
from ..schemas import RAW_INVOICE_COLUMNS, text_schema
from ..session import shared_folder

_FILE, _START, _ID = "__file", "__start", "__id"


def _scan(spark: SparkSession, multiline: bool):
    """Quotes are doubled inside quoted fields. Where fields may hold line breaks (``multiline``),
    Spark can't split a file; without them large files are split."""
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
    )


def _clean_header(df: DataFrame) -> DataFrame:
    """Header names without a byte-order mark and the quotes it may hide."""
    names = [name.replace("\ufeff", "").strip('"') for name in df.columns]
    return df if names == df.columns else df.toDF(*names)


def read_raw_invoices(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """The raw export: 19 columns by position, header skipped."""
    return _scan(spark, multiline).schema(text_schema(RAW_INVOICE_COLUMNS)).csv(path)


def _work(spark: SparkSession, work: str | None, label: str) -> str:
    return work or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def read_quoted(spark: SparkSession, path: str | Sequence[str], work: str | None = None) -> DataFrame:
    """Text rows of CSV files whose quoted fields may hold line breaks, read in many tasks.

    Spark's own reader gives such a file to one task. Here the files are read as lines, which
    Spark splits into blocks, and written once with their file, block and place. A line starts
    a row when the number of quote characters before it in its file is even: each block counts
    its quotes, the counts of earlier blocks are summed (one row per block), and each line adds
    those of its block before it. Lines of rows that end on their own line stay where they are;
    only the lines of rows that go on are brought together, by the row's first line. Each row is
    then parsed as one CSV record. The first row of each file is its header; the first file's
    header names the columns; blank lines between rows are skipped. Returns them as text with ``row_index`` and ``row_number`` as
    read_numbered does. Line breaks inside fields come back as \n, whatever they were.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_START),
        F.monotonically_increasing_id().alias(_ID),
    )
    where = _work(spark, work, "lines")
    lines.write.mode("overwrite").parquet(where)
    lines = spark.read.schema(lines.schema).parquet(where)
    odd = ((F.length("value") - F.length(F.regexp_replace("value", '"', ""))) % 2).cast("int")
    lines = lines.withColumn("_odd", odd)

    block = [_FILE, _START]
    blocks = lines.groupBy(*block).agg(
        F.count("*").alias("_n"), F.min(_ID).alias("_first"), (F.sum("_odd") % 2).alias("_block_odd")
    )
    earlier = Window.partitionBy(_FILE).orderBy(_START).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *block, "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lines_before"),
        (F.coalesce(F.sum("_block_odd").over(earlier), F.lit(0)) % 2).alias("_odd_before"),
    )
    inside = Window.partitionBy(*block).orderBy(_ID)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(blocks, block).select(
        "value", *block, _ID, "_odd",
        (F.col("_lines_before") + F.col(_ID) - F.col("_first")).alias("_line"),
        ((F.col("_odd_before") + F.coalesce(F.sum("_odd").over(before), F.lit(0))) % 2 == 0).alias("_starts"),
    )
    placed = placed.withColumn("_start_line", F.when(F.col("_starts"), F.col("_line")))
    placed = placed.withColumn("_last_start", F.max("_start_line").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    where = _work(spark, work and f"{work}-placed", "placed")
    placed.write.mode("overwrite").parquet(where)
    placed = spark.read.parquet(where)

    # Rows that go on past a block's first lines start in an earlier block of the file.
    last = placed.groupBy(*block).agg(F.max("_start_line").alias("_block_last"))
    carried = last.select(*block, F.max("_block_last").over(earlier).alias("_carried"))
    owned = placed.join(carried, block).withColumn("_row", F.coalesce("_last_start", "_carried"))
    whole = F.col("_starts") & (F.col("_odd") == 0)
    single = owned.filter(whole & (F.col("value") != "")).select(_FILE, _START, "_row", F.col("value").alias("_record"))
    pieces = owned.filter(~whole & F.col("_row").isNotNull())
    joined = pieces.groupBy(_FILE, "_row").agg(
        F.min_by(_START, "_line").alias(_START),
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("_line", "value"))), lambda x: x["value"])).alias("_record"),
    )
    records = single.unionByName(joined)
    where = _work(spark, work and f"{work}-records", "records")
    records.write.mode("overwrite").parquet(where)
    records = spark.read.parquet(where)

    header = records.filter(F.col("_row") == 0).orderBy(_FILE).select("_record").first()
    if header is None:
        return spark.createDataFrame([], "row_index long, row_number long")
    names = [n.replace("\ufeff", "").strip() for n in next(csv.reader([header[0]]))]
    ddl = ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in names)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    body = records.filter(F.col("_row") > 0)
    counts = body.groupBy(_FILE, _START).agg(F.count("*").alias("_rows"))
    every = Window.orderBy(_FILE, _START).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(every), F.lit(0)))
    counts = counts.join(counts.groupBy(_FILE).agg(F.min("_before").alias("_file_before")), _FILE)
    index = F.col("_before") + F.row_number().over(Window.partitionBy(_FILE, _START).orderBy("_row")) - 1
    numbered = body.join(counts, [_FILE, _START]).select(
        F.from_csv("_record", ddl, options).alias("_fields"), index.alias("row_index"), "_file_before"
    )
    return numbered.select(
        *[F.col(f"_fields.`{n}`").alias(n) for n in names],
        "row_index",
        (F.col("row_index") - F.col("_file_before") + FIRST_DATA_LINE).alias("row_number"),
    )


def read_numbered(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = False, work: str | None = None
) -> DataFrame:
    """Text rows with ``row_index`` (over all files, in path order, from 0) and ``row_number``
    (within the file, from 2, as the first line is the header).

    Rows are counted per file block and numbered inside it, so the numbering needs neither a
    sort nor a single task: the block counts (one row per block) are summed up and joined back.
    Counts and rows come from one reading, as a second one may cut the files elsewhere: the
    tagged rows are written to ``work``, by default a new place in the shared folder, and
    numbered from there. Files whose fields hold line breaks (``multiline``) are read by
    read_quoted, in many tasks.
    """
    if multiline:
        return read_quoted(spark, path, work)
    rows = _scan(spark, multiline).csv(path)
    tagged = _clean_header(
        rows.select(
            "*",
            F.col("_metadata.file_path").alias(_FILE),
            F.col("_metadata.file_block_start").alias(_START),
            F.monotonically_increasing_id().alias(_ID),
        )
    )
    work = _work(spark, work, "tagged")
    tagged.write.mode("overwrite").parquet(work)
    tagged = spark.read.schema(tagged.schema).parquet(work)
    blocks = tagged.groupBy(_FILE, _START).agg(F.count("*").alias("n"), F.min(_ID).alias("first_id"))
    earlier = Window.orderBy(_FILE, _START).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = placed.groupBy(_FILE).agg(F.min("before").alias("file_before"))
    offsets = placed.join(starts, _FILE).select(_FILE, _START, "first_id", "before", "file_before")
    index = F.col("before") + F.col(_ID) - F.col("first_id")
    return tagged.join(offsets, [_FILE, _START]).select(
        *[c for c in tagged.columns if c not in (_FILE, _START, _ID)],
        index.alias("row_index"),
        (index - F.col("file_before") + FIRST_DATA_LINE).alias("row_number"),
    )


def first_rows(numbered: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in file order."""
    return numbered if limit is None else numbered.filter(F.col("row_index") < int(limit))


def read_clean_invoices(
    spark: SparkSession, path: str | Sequence[str], limit: int | None = None, multiline: bool = False, work: str | None = None
) -> DataFrame:
    """A cleaned invoice file; ``row_number`` orders rows over all files."""
    rows = first_rows(read_numbered(spark, path, multiline, work), limit)
    return rows.withColumn("row_number", F.col("row_index") + FIRST_DATA_LINE).drop("row_index")


def read_upload(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = False, work: str | None = None
) -> DataFrame:
    """An uploaded file with the line number of each row."""
    return read_numbered(spark, path, multiline, work).drop("row_index")


def read_payment_reports(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = True, work: str | None = None
) -> DataFrame:
    """Payment-practice reports, whose fields do hold line breaks; ``original_row_index`` counts rows in file order from 0."""
    rows = read_numbered(spark, path, multiline, work)
    return rows.withColumnRenamed("row_index", "original_row_index").drop("row_number")


def read_ml_ready(spark: SparkSession, path: str) -> DataFrame:
    """Model-ready rows, Parquet or CSV; the company number stays text."""
    if str(path).lower().rstrip("/").endswith("csv"):
        rows = read_quoted(spark, path).drop("row_index", "row_number")  # fields may hold line breaks
        return rows.withColumn(GROUP, F.col(GROUP).cast("string"))
    return spark.read.parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Company profiles, Parquet or CSV; the registry id stays text."""
    if str(path).lower().rstrip("/").endswith("csv"):
        return _scan(spark, False).csv(path)
    return spark.read.parquet(path)
