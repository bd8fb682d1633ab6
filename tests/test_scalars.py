from datetime import date

import pytest
from pyspark.sql import functions as F

from careflow.functions import filters, scalars as S
from tests.conftest import rows


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def day(text):
    return F.lit(text).cast("date")


def test_month_overflow(spark):
    got = one(
        spark,
        S.add_months_overflow(day("2025-01-31"), 1),
        S.add_months_overflow(day("2024-02-29"), 12),
        S.referral_expiry(day("2025-01-15"), F.lit("")),
        S.referral_expiry(day("2025-01-15"), F.lit("0")),
        S.referral_expiry(day("2025-01-31"), F.lit("1 month")),
    )
    assert got == (date(2025, 3, 3), date(2025, 3, 1), date(2026, 1, 15), date(2026, 1, 15), date(2025, 3, 3))


def test_age_and_age_group(spark):
    middle = S.AGE_GROUPS[1]
    assert one(
        spark,
        S.age_years(day("2000-06-16"), "2025-06-15"),
        S.age_group(day("2000-06-16"), "2025-06-15"),
        S.age_years(day("2007-12-31"), "2025-01-01"),
        S.age_group(day("2007-12-31"), "2025-01-01"),
        S.age_group(F.lit(None).cast("date"), "2025-01-01"),
    ) == (24, middle, 17, middle, S.UNSPECIFIED)


def test_periods(spark):
    assert one(spark, *S.previous_period("2025-03-01", "2025-03-31")) == (date(2025, 1, 29), date(2025, 2, 28))
    expected = {
        ("monthly", "2024-02-10"): (date(2024, 2, 1), date(2024, 2, 29)),
        ("quarterly", "2025-05-10"): (date(2025, 4, 1), date(2025, 6, 30)),
        ("semi-annually", "2025-08-01"): (date(2025, 7, 1), date(2025, 12, 31)),
        ("annually", "2025-08-01"): (date(2025, 1, 1), date(2025, 12, 31)),
    }
    for (kind, d), bounds in expected.items():
        assert one(spark, *S.period_bounds(kind, d)) == bounds
    with pytest.raises(ValueError):
        S.period_bounds("weekly", "2025-01-01")


def test_month_days():
    assert [len(S.month_days(m)) for m in ("2024-02", "2025-02", "2025-12")] == [29, 28, 31]
    assert S.month_days("2025-12")[-1] == date(2025, 12, 31)


def test_invoice_texts(spark):
    assert one(
        spark,
        S.invoice_id("2025-03", F.lit(7)),
        S.claim_period(day("2025-03-02"), day("2025-03-30"), "2025-03"),
        S.claim_period(F.lit(None).cast("date"), day("2025-03-30"), "2025-03"),
    ) == ("INV-202503-7", "من 2025-03-02 إلى 2025-03-30", "2025-03")


def test_sheet_dates(spark):
    cells = ["45658.75", " 2025-01-01 ", "2025-02-30", "soon", "", None, "0", "1e300", "2025-1-1"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r[1] for r in rows(df.select("i", S.parse_sheet_date("c").alias("d")))]
    assert got == [date(2025, 1, 1), date(2025, 1, 1)] + [None] * 7


def test_numeric_prefix(spark):
    cells = ["12 mg", "abc", "<5", " -3.5e1x", "", ".5", "7.", None, "1e"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    assert [r[1] for r in rows(df.select("i", S.sqlite_real("c")))] == [12, 0, 0, -35, 0, 0.5, 7, None, 1]


@pytest.mark.parametrize(
    "kind,value,low,high,normal,expected",
    [
        ("number", "3.9", 4.0, 6.0, None, True),
        ("number", "5", 4.0, 6.0, None, False),
        ("number", "7 high", 4.0, 6.0, None, True),
        ("number", "n/a", 4.0, 6.0, None, True),
        ("number", "7", None, 6.0, None, True),
        ("number", "5", None, 6.0, None, False),
        ("text", " negative ", None, None, "Negative", False),
        ("text", "Positive", None, None, "Negative", True),
        ("text", "Positive", None, None, None, False),
        (None, "9", 1.0, 2.0, None, False),
    ],
)
def test_abnormal(spark, kind, value, low, high, normal, expected):
    df = spark.createDataFrame(
        [(kind, value, low, high, normal)], "k string, v string, lo double, hi double, n string"
    )
    assert df.select(S.abnormal("k", "v", "lo", "hi", "n")).first()[0] is expected


def test_search_is_ascii_only_with_wildcards(spark):
    names = ["Alpha", "ALPINE", "Àlpha", "a\\b", None, "100%"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def found(term):
        return [r[0] for r in rows(filters.search(df, term, ["name"]))]

    assert found("alp") == ["ALPINE", "Alpha"]
    assert found("à") == []
    assert found("A_p") == ["ALPINE", "Alpha"]
    assert found("a\\B") == ["a\\b"]
    assert len(found("")) == 6


def test_expiry_status_overlaps(spark):
    df = spark.createDataFrame(
        [(1, date(2025, 1, 10)), (2, date(2025, 1, 9)), (3, date(2025, 2, 9)), (4, date(2025, 2, 10)), (5, None)],
        "id int, e date",
    )

    def ids(status):
        return [r[0] for r in rows(filters.expiry_status(df, "e", "2025-01-10", status), "id")]

    assert ids("active") == [1, 3, 4]
    assert ids("expiring") == [1, 3]
    assert ids("expired") == [2]
    with pytest.raises(ValueError):
        filters.expiry_condition("e", "2025-01-10", "gone")


def test_weekday_tokens(spark):
    df = spark.createDataFrame([(1, "Sat, Mon"), (2, "Sunday"), (3, None), (4, "Sun")], "id int, d string")
    assert [r[0] for r in rows(filters.has_token(df, "d", "Sun"), "id")] == [4]
    assert one(spark, S.weekday_token(day("2025-01-05"))) == ("Sun",)


def test_integers_and_labels(spark):
    cells = ["3", "3.0", "-1", "2.5", "x", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r[1:] for r in rows(df.select("i", S.is_non_negative_int("c"), S.int_part("c")))]
    assert got == [(True, 3), (True, 3), (False, -1), (False, 2), (False, None), (False, None)]
    assert one(
        spark,
        S.label_or_default(F.lit(""), "x"),
        S.number_or_default(F.lit(0.0), 200.0),
        S.shift_hours(F.lit("NM")),
        S.shift_hours(F.lit("?")),
    ) == ("x", 200.0, 18, 0)


def test_sql_text(spark):
    df = spark.createDataFrame([("O'Neil", 8.0, 0.5, None)], "a string, b double, c double, d string")
    got = df.select(*[S.sql_literal(S.plain_text(c, t)) for c, t in df.dtypes]).first()
    assert tuple(got) == ("'O''Neil'", "'8'", "'0.5'", "NULL")


def test_doubles_as_a_script_writes_them(spark):
    pairs = [
        (12345678.5, "12345678.5"), (0.0005, "0.0005"), (1e15, "1000000000000000"), (1e21, "1e+21"), (1.5e21, "1.5e+21"), (1e-6, "0.000001"),
        (1.25e-7, "1.25e-7"), (-2.0, "-2"), (0.0, "0"), (-0.0, "0"), (2.5, "2.5"), (1e20, "100000000000000000000"), (-1234567890.125, "-1234567890.125"),
    ]
    df = spark.createDataFrame([(x,) for x, _ in pairs], "x double")
    assert [r[0] for r in df.select(S.plain_text("x", "double")).collect()] == [t for _, t in pairs]


def test_last_serial_of_a_sheet(spark):
    df = spark.createDataFrame([("2958465",), ("2958466",), ("-693594",)], "x string")
    assert [str(r[0]) for r in df.select(S.parse_sheet_date("x")).collect()][:2] == ["9999-12-31", "None"]
