"""Column expressions on examples, good and bad."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import dates, numbers, text


def values(spark, inputs, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def known(c):
    return text.known_or_null(text.strip(c))


def test_trim_rules(spark):
    inputs = ["  a ", "", "   ", "\ta ", None]
    assert values(spark, inputs, text.blank_to_null) == ["a", None, None, "\ta ", None]
    assert values(spark, inputs, text.strip_to_null) == ["a", None, None, "a", None]


def test_missing_words(spark):
    inputs = [" None ", "NULL", "nan", "N/A", "n/a.", "x", ""]
    assert values(spark, inputs, known) == [None, None, None, None, "n/a.", "x", None]


def test_company_identity(spark):
    assert values(spark, ["  Acme \t  plc "], lambda c: text.company_name(text.strip(c))) == ["ACME PLC"]
    inputs = ["123", "sc1234", "123456789", "00000001", "12a"]
    assert values(spark, inputs, text.company_number) == ["00000123", "SC1234", "123456789", "00000001", "12A"]


def test_registry_key(spark):
    inputs = ["123", "0000000123", "abc", "12345678901", "-5", None]
    expected = ["0000000123", "0000000123", "0000000abc", "12345678901", "-000000005", None]
    assert values(spark, inputs, text.registry_key) == expected


def test_flags(spark):
    inputs = ["TRUE", "y", "No", "0", "By letter", "none"]
    assert values(spark, inputs, lambda c: text.yes_no_text(known(c))) == ["True", "True", "False", "False", "By letter", None]
    inputs = [None, "n/a", "yes", "N", "There was no change.", "Terms not changed", "New terms"]
    expected = ["Unknown", "Unknown", "Yes", "No", "No", "No", "Yes"]
    assert values(spark, inputs, lambda c: text.terms_changed_flag(known(c))) == expected
    found = values(spark, ["Covidien deal", "none", None], lambda c: text.mentions_any(c, ("covid",)))
    assert found == [1, 0, 0]


def test_amount_text(spark):
    inputs = ["£1,234.50", "55%", "None", "(12.5)", "abc", "1e3", "1d", " £ 7 ", "-3", ".5", "5.", "inf"]
    expected = [1234.5, 55.0, None, -12.5, None, 1000.0, None, 7.0, -3.0, 0.5, 5.0, None]
    assert values(spark, inputs, numbers.amount_text) == expected


def test_leading_number_like_sqlite(spark):
    inputs = ["12abc", "abc", " 3.5e2x", None, "-4.", "2.9"]
    assert values(spark, inputs, numbers.leading_real) == [12.0, 0.0, 350.0, None, -4.0, 2.9]
    ids = values(spark, ["1930438491.0", None, "x"], lambda c: numbers.whole_text(numbers.leading_real(c)))
    assert ids == ["1930438491", "0", "0"]


def test_rounding_follows_python(spark):
    inputs = [0.125, 2.675, 0.5, 1.005, 33.35, 66.65, -0.25, 1e6 / 3]
    assert values(spark, inputs, lambda c: numbers.rounded(c, 2), "double") == [round(v, 2) for v in inputs]
    assert values(spark, inputs, lambda c: numbers.fixed_text(c, 1), "double") == [f"{v:.1f}" for v in inputs]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2020-1-5", date(2020, 1, 5)),
        ("05-01-2020", date(2020, 1, 5)),
        ("01/05/2020", date(2020, 1, 5)),
        ("13/05/2020", date(2020, 5, 13)),
        ("2020/01/05", date(2020, 1, 5)),
        ("2020-02-30", None),
        ("20-01-05", None),
        ("2020-01-05 00:00", None),
        ("12020-01-05", None),
        ("soon", None),
    ],
)
def test_upload_dates(spark, value, expected):
    assert values(spark, [value], lambda c: dates.upload_date(dates.date_shaped(c))) == [expected]


def test_dates_that_run_over(spark):
    iso = values(spark, ["2021-02-30", "2021-13-01", "2021-01-32", "2021-1-1"], dates.rolling_iso_date)
    assert iso == [date(2021, 3, 2), None, None, None]

    def compact(c):
        return dates.rolling_compact_date(dates.compact_digits(c))

    inputs = ["20210115", "20210115.0", "20210230", "20211301", "0020210115", "x", "20210115777"]
    day = date(2021, 1, 15)
    assert values(spark, inputs, compact) == [day, day, date(2021, 3, 2), None, day, None, day]
