"""CSV files whose quoted fields hold line breaks, read in many tasks."""

import csv
import io
import random

from ledgermill.sources import csv_files


def _write(path, rows, header=("id", "text", "n"), bom=False, crlf=False):
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n" if crlf else "\n").writerows([header, *rows])
    path.write_text(("﻿" if bom else "") + out.getvalue(), encoding="utf-8")


def test_many_blocks_give_the_rows_and_numbers_of_one_task(spark, tmp_path):
    rng = random.Random(7)
    texts = ["plain", "two\nlines", 'quote "inside", comma', "three\nlines\n\nwith a blank", "", "x" * 300, "end\n"]
    first = [(str(k), rng.choice(texts), str(rng.randint(0, 9))) for k in range(400)]
    second = [(str(k), rng.choice(texts), str(k % 3)) for k in range(400, 460)]
    folder = tmp_path / "in"
    folder.mkdir()
    _write(folder / "a.csv", first, bom=True)
    _write(folder / "b.csv", second, crlf=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        got = csv_files.read_numbered(spark, str(folder), multiline=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(*r, k, k + 2) for k, r in enumerate(first)] + [(*r, 400 + k, k + 2) for k, r in enumerate(second)]
    rows = sorted((r["id"], r["text"] or "", r["n"], r["row_index"], r["row_number"]) for r in got)
    assert rows == sorted((i, t, n, k, line) for i, t, n, k, line in want)
    one_task = csv_files._scan(spark, True).csv(str(folder))
    assert sorted((r["id"], r["text"] or "") for r in one_task.collect()) == sorted((r[0], r[1]) for r in rows)


def test_header_only_and_empty_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,text\n")
    assert csv_files.read_quoted(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_text("")
    assert csv_files.read_quoted(spark, str(tmp_path / "e")).count() == 0
