"""Import and recalculation over stored tables: repeat runs, closing, re-opening."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgermill.plans import enrichment_jobs, import_job, recalculation
from ledgermill.plans.reports import collection_action_queue, customer_risk_overview, risk_dashboard
from ledgermill.sources.tables import TableStore

HEADER = "business_code,customer_id,customer_name,clear_date,posting_date,due_date,currency,invoice_amount,invoice_id,is_open,payment_delay_days,is_late\n"


def paid(customer, n, late=True):
    delay = 20 if late else -1
    return f"U001,{customer},Acme,2020-02-21,2020-01-{n % 27 + 1:02d},2020-02-01,USD,1000,{customer}-P{n},0,{delay},{int(late)}\n"


def unpaid(customer, n, amount, due):
    return f"U001,{customer},Acme Ltd,,2020-03-01,{due},USD,{amount},{customer}-O{n},1,,\n"


def upload(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text(HEADER + "".join(lines), encoding="utf-8")
    return str(path)


def at(hour):
    return datetime(2020, 6, 1, hour)


def test_whole_flow(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    lines = [paid("C1", n, n < 6) for n in range(10)]
    lines += [unpaid("C1", n, 6000, "2020-03-15") for n in range(9)]
    lines += [unpaid("C1", 9, 50000, "2020-03-15"), paid("C2", 1, False), unpaid("C2", 1, 10, "2020-05-20")]
    lines += ["U001,C3,Late posting,,2020-05-22,2020-06-30,USD,5,C3-1,1,,\n"]
    lines += ["U001,,No customer,,2020-03-01,2020-03-15,USD,5,BAD-1,1,,\n"]
    result = import_job.run_import_job(store, upload(tmp_path, "one.csv", *lines), run_at=at(1))
    assert result["status"] == "Completed With Errors"
    assert (result["validation"]["valid_rows"], result["validation"]["invalid_rows"]) == (23, 1)
    assert result["validation"]["error_summary"] == "Row 25: Missing customer_id"
    assert result["import"]["customers_created"] == 3 and result["import"]["customers_updated"] == 20
    assert result["import"]["invoices_created"] == 23 and result["import"]["customers_summarized"] == 3
    recalculated = result["recalculation"]
    assert recalculated["status"] == "success"
    steps = {k: recalculated[k]["result"] for k, _ in recalculation.STEPS}
    assert steps["customer_aggregation"] == {"customers_seen": 3, "customers_created": 0, "customers_updated": 3}
    assert steps["invoice_risk_assessment"]["assessments_created"] == 12
    assert steps["invoice_risk_assessment"]["analysis_date"] == "2020-05-22"

    c1 = store.read("customers").filter("customer_id = 'C1'").first()
    assert (c1["risk_level"], c1["customer_name"], c1["total_invoices"], c1["open_invoice_count"]) == (
        "High", "Acme", 20, 10)
    big = store.read("assessments").filter("external_invoice_id = 'C1-O9'").first()
    assert (big["days_overdue"], big["risk_level"]) == (68, "High")
    created = steps["collection_action_generation"]["actions_created"]
    assert created == store.read("actions").count() > 0
    queue = collection_action_queue(store.read("actions"), {"customer_id": "C1"})
    assert queue.first()["due_date"] == date(2020, 5, 22)

    # A second run changes nothing: no new actions, no audit rows.
    audits = store.read_appended("audit").count()
    again = recalculation.recalculate(store, run_at=at(2))
    assert again["collection_action_generation"]["result"]["actions_created"] == 0
    assert again["collection_action_generation"]["result"]["actions_skipped_existing"] == created
    assert store.read_appended("audit").count() == audits
    assert again["invoice_risk_assessment"]["result"]["assessments_updated"] == 12

    # The large invoice is paid: its assessment closes and its action is resolved.
    closing = "U001,C1,Acme,2020-05-25,2020-03-01,2020-03-15,USD,50000,C1-O9,0,71,1\n"
    result = import_job.run_import_job(store, upload(tmp_path, "two.csv", closing), run_at=at(3))
    assert result["status"] == "Completed"
    assert (result["import"]["invoices_created"], result["import"]["invoices_updated"]) == (0, 1)
    big = store.read("assessments").filter("external_invoice_id = 'C1-O9'").first()
    assert (big["is_open"], big["risk_score"], big["suggested_action"]) == (0, 0, "No action - invoice closed")
    done = store.read("actions").filter("external_invoice_id = 'C1-O9'").first()
    assert (done["status"], done["active_invoice_key"]) == ("Resolved", None)
    assert done["notes"].count("\n\nAuto-resolved because") == 1
    closed = store.read_appended("audit").filter("external_invoice_id = 'C1-O9' and new_score = 0")
    assert closed.count() == 1

    # Opened again, it gets a new action beside the resolved one.
    reopened = unpaid("C1", 9, 50000, "2020-03-15")
    import_job.run_import_job(store, upload(tmp_path, "three.csv", reopened), run_at=at(4))
    statuses = store.read("actions").filter("external_invoice_id = 'C1-O9'").select("status").collect()
    assert sorted(r["status"] for r in statuses) == ["Open", "Resolved"]
    ids = store.read("actions").select("action_id")
    assert ids.count() == ids.distinct().count()

    jobs = store.read_appended("import_jobs").orderBy("started_on").collect()
    assert [j["status"] for j in jobs] == ["Completed With Errors", "Completed", "Completed"]
    assert jobs[0]["recalculation_status"] == "Completed"

    customers, assessments, actions = (store.read(n) for n in ("customers", "assessments", "actions"))
    assert customer_risk_overview(customers, {"risk_level": "High"}).first()["customer_id"] == "C1"
    views = risk_dashboard(customers, assessments, actions)
    assert views["summary"].first()["total_customers"] == 3
    assert [r["risk_level"] for r in views["chart"].collect()] == ["Low", "Medium", "High"]
    exported = enrichment_jobs.export_first_customers(customers, str(tmp_path / "review"), 2)
    assert exported["rows_exported"] == 2


def test_bad_uploads(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    path = tmp_path / "short.csv"
    path.write_text("customer_id,invoice_id\nC1,1\n")
    with pytest.raises(ValueError, match="No valid rows"):
        import_job.run_import_job(store, str(path), run_at=at(1))
    job = store.read_appended("import_jobs").first()
    assert job["status"] == "Validation Failed"
    assert job["error_summary"].startswith("Missing required columns: posting_date")


def test_last_row_wins_and_limit(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    rows = [unpaid("C1", 1, amount, "2020-03-15") for amount in (1, 2, 3)]
    path = upload(tmp_path, "repeat.csv", *rows)
    stats = import_job.import_dataset(store, path, limit=2, run_at=at(1))
    assert (stats["rows_seen"], stats["invoices_created"], stats["invoices_updated"]) == (2, 1, 1)
    invoice = store.read("invoices").first()
    assert (float(invoice["invoice_amount"]), invoice["status"], invoice["days_overdue"]) == (2.0, "Overdue", 77)


def test_bad_rows_are_kept_aside(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    lines = [unpaid("C1", 1, -5, "2020-03-15"), paid("C1", 1).replace(",20,1\n", ",soon,1\n"), paid("C1", 2)]
    stats = import_job.import_dataset(store, upload(tmp_path, "x.csv", *lines), run_at=at(1))
    assert (stats["rows_seen"], stats["rows_rejected"]) == (1, 2)
    rejects = store.read_appended("rejects")
    kept = rejects.select(F.explode("messages")).collect()
    assert {r["stage"] for r in rejects.collect()} == {"import"}
    assert any('"invoice_amount":"-5"' in r["row_text"] or '"invoice_amount":-5' in r["row_text"] for r in rejects.collect())
    assert sorted(r[0] for r in kept) == ["Invalid payment_delay_days", "Invoice Amount cannot be negative."]


def test_failed_step_is_named(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    summary = recalculation.recalculate(store, run_at=at(1))
    assert (summary["status"], summary["failed_step"]) == ("failed", "invoice_risk_assessment")


def test_an_invoice_without_customer_is_kept_aside(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    import_job.import_dataset(store, upload(tmp_path, "x.csv", unpaid("C1", 1, 5, "2020-03-15")), run_at=at(1))
    people = store.read("customers")
    lost = store.read("invoices").withColumn("customer_id", F.lit("C9")).withColumn("invoice_id", F.lit("LOST"))
    store.replace("invoices", store.read("invoices").unionByName(lost))
    step = recalculation.assessment_step(store, None, date(2020, 6, 1), F.current_timestamp(), "r1")
    assert step["errors"] == 1 and people.count() == 1
    row = store.read_appended("rejects").filter("stage = 'assessment'").first()
    assert (row["row_key"], row["messages"]) == ("LOST", [recalculation.NO_CUSTOMER])


def test_streamed_files(spark, tmp_path):
    from ledgermill.schemas import CLEAN_INVOICE_COLUMNS
    from ledgermill.streaming.imports import stream_imports

    store = TableStore(spark, str(tmp_path / "store"))
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def drop(name, **fields):
        line = ",".join(str(fields.get(c, "")) for c in CLEAN_INVOICE_COLUMNS)
        (inbox / name).write_text(",".join(CLEAN_INVOICE_COLUMNS) + "\n" + line + "\n")
        stream_imports(store, str(inbox), str(tmp_path / "progress")).awaitTermination()

    base = dict(customer_id="C1", posting_date="2020-01-01", due_date="2020-01-31", is_open=1)
    drop("a.csv", invoice_id="1", invoice_amount=5, **base)
    drop("b.csv", invoice_id="1", invoice_amount=9, **base)
    rows = store.read("invoices").collect()
    assert [(r["invoice_id"], float(r["invoice_amount"])) for r in rows] == [("1", 9.0)]
    runs = {r["run"] for r in store.read_appended("rejects").collect()}
    drop("c.csv", invoice_id="2", invoice_amount="x", **base)
    stream_imports(store, str(inbox), str(tmp_path / "fresh")).awaitTermination()
    again = {r["run"] for r in store.read_appended("rejects").collect()}
    assert not runs and len(again) == 2  # the fresh stream did not replace the first one's reject



def _files(root):
    """Data files of a table's latest snapshot by relative path, with their modification times."""
    latest = sorted(p for p in root.iterdir() if p.name.startswith("v"))[-1]
    return {str(f.relative_to(latest)): f.stat().st_mtime_ns for f in latest.rglob("*.parquet")}


def _changed(before, after):
    """Partition folders whose files were added, removed or rewritten."""
    moved = set(before) ^ set(after) | {k for k in after if k in before and before[k] != after[k]}
    return {k.split("/")[0] for k in moved}


def test_one_key_import_rewrites_one_partition(spark, tmp_path):
    from ledgermill.sources.tables import part_of

    def partition(key):
        return f"_part={spark.createDataFrame([(key,)], 'k string').select(part_of('k')).first()[0]}"

    store = TableStore(spark, str(tmp_path / "store"))
    lines = [unpaid(f"C{k}", k, 100 + k, "2020-05-15") for k in range(200)]
    import_job.import_dataset(store, upload(tmp_path, "many.csv", *lines), run_at=at(1))
    invoices, people = _files(tmp_path / "store/invoices"), _files(tmp_path / "store/customers")
    assert len({k.split("/")[0] for k in invoices}) > 50  # the keys fill most of the 64 partitions
    full = {r["invoice_id"]: r for r in store.read("invoices").collect()}

    for repeat in range(2):  # the same import again rewrites the same partition to the same rows
        import_job.import_dataset(store, upload(tmp_path, f"one{repeat}.csv", unpaid("C7", 7, 999, "2020-05-15")), run_at=at(2))
        now_invoices, now_people = _files(tmp_path / "store/invoices"), _files(tmp_path / "store/customers")
        assert _changed(invoices, now_invoices) == {partition("C7-O7")}
        assert _changed(people, now_people) == {partition("C7")}
        invoices, people = now_invoices, now_people
        rows = {r["invoice_id"]: r for r in store.read("invoices").collect()}
        assert set(rows) == set(full) and rows["C7-O7"]["invoice_amount"] == 999
        assert all(rows[k] == full[k] for k in full if k != "C7-O7")
    c7 = store.read("customers").filter("customer_id = 'C7'").first()
    assert (c7["invoice_count"], c7["customer_name"]) == (1, "Acme Ltd")
    assert store.read("customers").count() == 200


def test_a_keyed_table_has_one_file_per_partition(spark, tmp_path):
    """Not one from every task: files would grow with tasks times partitions."""
    from ledgermill.sources import tables

    store = TableStore(spark, str(tmp_path / "store"))
    rows = spark.range(0, 6400, 1, 8).select(F.col("id").cast("string").alias("customer_id"))
    store.replace("customers", rows)
    assert len(store.current("customers").inputFiles()) == tables.PARTS
    store.merge("customers", rows, lambda now: now.repartition(8), "r")
    assert len(store.current("customers").inputFiles()) == tables.PARTS
    assert store.read("customers").select("customer_id").distinct().count() == 6400


def test_import_types_its_rows_once(spark, tmp_path, monkeypatch):
    """Rejected rows come from the written rows, which are not typed again for them."""
    from ledgermill.plans import import_job

    sides, split = [], import_job.constraints.split_checked
    monkeypatch.setattr(import_job.constraints, "split_checked", lambda df: sides.append(df.inputFiles()) or split(df))
    store = TableStore(spark, str(tmp_path / "store"))
    rows = [(1, "C1", "I1", "5.00"), (2, "C1", "I2", "-5.00"), (3, "", "I3", "1.00")]
    data = spark.createDataFrame(rows, "row_number long, customer_id string, invoice_id string, invoice_amount string")
    import_job.import_rows(store, data, "2020-05-31", F.lit(None).cast("timestamp"), "r")
    assert sides and all("/rows/" in f for f in sides[0]) and sides[0]
    assert [r[0] for r in store.read("invoices").select("invoice_id").collect()] == ["I1"]
    assert sorted(r[0] for r in store.read_appended("rejects").select("row_key").collect()) == ["2", "3"]
