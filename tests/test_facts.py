"""Company facts: picking, ratios, bands, sources and quality."""

import json
import zipfile

import pytest

from ledgermill.operators import facts
from ledgermill.plans import enrichment_jobs
from ledgermill.sources.documents import read_documents


def fact(val, filed="2024-01-30", end="2023-12-31", form="10-K"):
    return {"val": val, "filed": filed, "end": end, "form": form}


def document(cik="123", **concepts):
    gaap = {c: {"units": {"USD": v if isinstance(v, list) else [fact(v)]}} for c, v in concepts.items()}
    return {"cik": cik, "entityName": "Example", "sic": "7370", "sicDescription": "Services", "facts": {"us-gaap": gaap}}


FULL = dict(Revenues=1000, CashAndCashEquivalentsAtCarryingValue=200, AssetsCurrent=500, LiabilitiesCurrent=250,
            Assets=2000, Liabilities=900, NetIncomeLoss=100)


def profiles(spark, *documents):
    texts = spark.createDataFrame([(n, json.dumps(d)) for n, d in enumerate(documents)], "n int, value string")
    return facts.company_profiles(facts.parse_documents(texts), "n").orderBy("n").collect()


def test_profile(spark):
    row = profiles(spark, document(**FULL))[0]
    assert (row["cik"], row["entity_name"], row["sic_description"]) == ("0000000123", "Example", "Services")
    assert (row["current_ratio"], row["net_margin"], row["liabilities_to_assets"]) == (2.0, 0.1, 0.45)
    assert (row["latest_filed_date"], row["latest_fiscal_period_end"]) == ("2024-01-30", "2023-12-31")
    assert row["sec_financial_risk_band"] == "Low"
    assert [c for c in row.asDict() if c != "n"] == facts.PROFILE_COLUMNS


def test_unreadable_documents_are_set_aside(spark, tmp_path):
    for name, text in (("a", json.dumps(document(**FULL))), ("b", "{not json"), ("c", " "), ("d", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    result = enrichment_jobs.process_company_facts(spark, str(tmp_path), str(tmp_path / "out"))
    assert (result["companies_processed"], result["documents_rejected"]) == (2, 2)
    rejects = spark.read.parquet(result["rejects_path"]).orderBy("row_key").collect()
    assert [r["row_key"][-6:] for r in rejects] == ["b.json", "c.json"] and "not json" in rejects[0]["row_text"]


def test_choice_of_facts(spark):
    rows = profiles(
        spark,
        document(Revenues=[fact(1, "2023-01-01"), fact(2, "2024-01-01"), fact(3, "2024-01-01", "2023-01-31")]),
        document(Revenues=[fact(5), fact(6)]),
        document(Revenues=[fact("n/a"), fact(7, form="8-K"), fact(8, "", "")], SalesRevenueNet=[fact("9", "soon")]),
        document(Revenues=[fact(1, "2001-01-01")], SalesRevenueNet=[fact(2, "2024-01-01")]),
        {"cik": None, "entity_name": "Alias", "facts": {}},
    )
    assert [r["revenue"] for r in rows] == [2.0, 5.0, 9.0, 1.0, None]
    assert rows[2]["latest_filed_date"] == "soon"
    assert (rows[4]["cik"], rows[4]["entity_name"], rows[4]["sec_financial_risk_band"]) == (None, "Alias", "Unknown")


@pytest.mark.parametrize(
    ("changes", "band"),
    [
        ({"AssetsCurrent": 200, "CashAndCashEquivalentsAtCarryingValue": 10}, "High"),
        ({"AssetsCurrent": 200}, "Medium"),
        ({"AssetsCurrent": 300, "NetIncomeLoss": -10}, "Medium"),
        ({"AssetsCurrent": 300}, "Low"),
        ({}, "Low"),
    ],
)
def test_bands(spark, changes, band):
    assert profiles(spark, document(**{**FULL, **changes}))[0]["sec_financial_risk_band"] == band


def test_sources_and_job(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for n, place in enumerate(("a.json", "b.json", "deep/c.json")):
        (folder / place).write_text(json.dumps(document(cik=str(n), **FULL)))
    (folder / "note.txt").write_text("not a document")
    archive = tmp_path / "all.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(folder.rglob("*.json")):
            out.write(path, path.relative_to(folder))
    assert read_documents(spark, str(folder)).count() == 3
    assert read_documents(spark, str(archive), 2).count() == 2
    assert read_documents(spark, str(folder / "a.json")).count() == 1
    with pytest.raises(ValueError, match="Unsupported"):
        read_documents(spark, str(folder / "note.txt"))
    result = enrichment_jobs.process_company_facts(spark, str(folder), str(tmp_path / "out.csv"), 2, "csv")
    assert result["companies_processed"] == 2
    report = enrichment_jobs.company_fact_quality(spark, str(tmp_path / "out.csv"), str(tmp_path / "report"))
    found = {(r["section"], r["metric"]): r["value"] for r in report.collect()}
    assert found["counts", "total_companies"] == 2 and found["counts", "unique_ciks"] == 2
    assert found["counts", "missing_core.revenue"] == 0
    assert found["risk_band_distribution", "Low"] == 2 and found["top_sic_descriptions", "Services"] == 2


def test_quality_of_absent_columns(spark):
    frame = spark.createDataFrame([("1", -5.0, 21.0, -6.0), (None, 1.0, None, 1.0)],
                                  "cik string, revenue double, current_ratio double, net_margin double")
    found = {r["metric"]: r["value"] for r in facts.profile_quality(frame).collect()}
    assert found["missing_entity_name"] is None and found["negative_equity_count"] is None
    assert (found["unique_ciks"], found["negative_revenue_count"]) == (1, 1)
    assert (found["extreme_current_ratio_count"], found["extreme_net_margin_count"]) == (1, 1)
