"""Upload validation: messages, totals and summaries; CSV numbering."""

from ledgermill.operators import validation
from ledgermill.schemas import REQUIRED_UPLOAD_COLUMNS
from ledgermill.sources import csv_files

SCHEMA = "row_number bigint, " + ", ".join(f"{c} string" for c in REQUIRED_UPLOAD_COLUMNS)


def check(spark, *rows):
    frame = spark.createDataFrame([(n + 2, *r) for n, r in enumerate(rows)], SCHEMA)
    return validation.validate_rows(frame)


def test_header():
    assert validation.header_errors(REQUIRED_UPLOAD_COLUMNS) == []
    assert validation.header_errors([" customer_id ", "invoice_id", ""]) == [
        "Missing required columns: posting_date, due_date, invoice_amount, is_open"
    ]


def test_row_messages(spark):
    out = check(
        spark,
        ("", "INV-001", "not-a-date", "2020-02-01", "abc", "3"),
        ("CUST-001", "INV-001", "2020-01-01", "2020-02-01", "100.50", "1"),
        ("CUST-001", "INV-001", "2020-01-01", "2020-02-01", "nan", "yes"),
    ).orderBy("row_number")
    assert [r["errors"] for r in out.collect()] == [
        ["Row 2: Missing customer_id", "Row 2: Invalid invoice_amount", "Row 2: is_open must be 0 or 1",
         "Row 2: Invalid posting_date"],
        [],
        ["Row 4: Invalid invoice_amount", "Row 4: Invalid is_open"],
    ]


def test_flag_counts_by_its_whole_part(spark):
    base = ("C", "I", "2020-01-01", "2020-02-01", "1")
    out = check(spark, *[(*base, flag) for flag in ("1.9", "-0.5", "2", "-1", "0")]).orderBy("row_number")
    assert [len(r["errors"]) for r in out.collect()] == [0, 0, 1, 1, 0]


def test_summary_shows_the_first_messages(spark):
    bad = check(spark, *[("", "I", "2020-01-01", "2020-02-01", "1", "1")] * 24)
    row = validation.error_summary(validation.row_errors(bad), 3).first()
    assert row["error_summary"].split("\n") == [
        "Row 2: Missing customer_id", "Row 3: Missing customer_id", "Row 4: Missing customer_id", "... 21 more errors"]
    totals = validation.validation_totals(bad).first()
    assert (totals["status"], totals["invalid_rows"]) == ("Validation Failed", 24)
    empty = validation.validation_totals(bad.limit(0)).first()
    assert (empty["status"], empty["total_rows"], empty["error_count"]) == ("Validated", 0, 0)


def test_numbering_over_blocks_and_files(spark, tmp_path):
    """Small blocks split both files; numbers must follow the files' own order."""
    for name, first, count in (("a.csv", 0, 700), ("b.csv", 700, 1500)):
        lines = "\n".join(f"{n},value {n}" for n in range(first, first + count))
        (tmp_path / name).write_text("﻿key,text\n" + lines + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = csv_files.read_numbered(spark, str(tmp_path), multiline=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 2200
    assert all(int(r["key"]) == r["row_index"] for r in rows)
    assert all(r["row_number"] == r["row_index"] + 2 - (700 if r["row_index"] >= 700 else 0) for r in rows)


def test_numbers_do_not_depend_on_how_a_file_is_cut(spark, tmp_path):
    lines = "\n".join(f"{n},value {n}" for n in range(3000))
    (tmp_path / "a.csv").write_text("key,text\n" + lines + "\n", encoding="utf-8")
    found = []
    for size in ("2048", "9999"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            numbered = csv_files.read_numbered(spark, str(tmp_path / "a.csv"), work=str(tmp_path / f"tagged-{size}"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        # Other settings hold when the rows are read; the numbers come from the tagged rows.
        found.append({int(r["key"]): r["row_number"] for r in numbered.collect()})
    assert found[0] == found[1] == {n: n + 2 for n in range(3000)}


def test_rows_are_read_once_without_a_work_folder(spark, tmp_path):
    """Rows and block counts come from the written rows, also where no folder is given."""
    path = tmp_path / "a.csv"
    path.write_text("key,text\n" + "\n".join(f"{n},value {n}" for n in range(300)) + "\n", encoding="utf-8")
    for read in (csv_files.read_numbered, csv_files.read_clean_invoices, csv_files.read_upload, csv_files.read_payment_reports):
        assert all(not f.endswith(".csv") for f in read(spark, str(path)).inputFiles())
    numbered = csv_files.read_numbered(spark, str(path))
    path.write_text("key,text\n", encoding="utf-8")
    assert {int(r["key"]): r["row_number"] for r in numbered.collect()} == {n: n + 2 for n in range(300)}


def test_limit_and_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "clean.csv"
    path.write_text('customer_id,invoice_id,note\nC1,1,"two\nlines"\nC2,2,"a ""b"""\nC3,3,\n', encoding="utf-8")
    rows = csv_files.read_clean_invoices(spark, str(path), limit=2, multiline=True).orderBy("row_number").collect()
    assert [(r["row_number"], r["invoice_id"], r["note"]) for r in rows] == [(2, "1", "two\nlines"), (3, "2", 'a "b"')]
