"""Column functions on the literal values the reference's self-tests use (FIXTURES.md 1.2)."""

import datetime as dt

from pyspark.sql import functions as F

from paysift.functions import amounts as AM
from paysift.functions import dates as D
from paysift.functions import names as N
from paysift.functions.keys import business_key


def one(spark, col_expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(col_expr).collect()]


def test_amount_shapes(spark):
    vals = ["1 234,56", "(500,00)", "1234.56", "1.234,56", "1234,56", "100 CAD", "12,50 $", "-45.10 CAD",
            "1 234,56", "n/a", "", None, "(1 000,00)"]
    got = one(spark, AM.amount_to_cents(F.col("v")), vals)
    assert got == [123456, -50000, 123456, 123456, 123456, 10000, 1250, -4510, 123456, None, None, None,
                   -100000]


def test_amount_rounds_half_up(spark):
    # X11: 1.15 -> 115 cents (truncation would give 114), 2.675 -> 268
    assert one(spark, AM.amount_to_cents(F.col("v")), ["1.15", "2.675", "-2.675"]) == [115, 268, -268]


def test_strict_decimal(spark):
    got = one(spark, AM.strict_decimal(F.col("v")), ["12.5", "-3", "1 000", "=A+B"])
    assert [float(x) for x in got] == [12.5, -3.0, 0.0, 0.0]


def test_currency(spark):
    assert one(spark, AM.norm_currency(F.col("v")), ["$", "c$", "CA$", "usd", "eur", "gbp"]) == \
        ["CAD", "CAD", "CAD", "USD", "EUR", "GBP"]


def test_dates_all_shapes(spark):
    vals = ["2023-01-15", "15/01/2023", "15-01-2023", "44941", "2023-15-01", "2025-08-28 00:00:00", "INVALID",
            "31/02/2023"]
    got = one(spark, D.parse_pay_date(F.col("v"), 2000, 2050), vals)
    d = dt.date
    assert got == [d(2023, 1, 15), d(2023, 1, 15), d(2023, 1, 15), d(2023, 1, 15), d(2023, 1, 15),
                   d(2025, 8, 28), None, None]


def test_excel_serial_origin(spark):
    # 45897 -> 2025-08-28 with the 1900 system
    assert one(spark, D.serial_to_date(F.col("v")), ["45897"]) == [dt.date(2025, 8, 28)]


def test_year_window(spark):
    assert one(spark, D.parse_pay_date(F.col("v")), ["1995-01-15", "2025-01-15"]) == [None, dt.date(2025, 1, 15)]


def test_matricule(spark):
    got = one(spark, N.norm_matricule(F.col("v")), [" 000085 ", "000", "mat001", "1001"])
    assert got == ["85", "0", "MAT001", "1001"]


def test_employee_key_falls_back_to_name(spark):
    df = spark.createDataFrame([(None, "Élodie  Tremblay"), ("0042", "x")], "m string, n string")
    got = [r[0] for r in df.select(N.employee_key("m", "n")).collect()]
    import hashlib
    assert got == [hashlib.md5("elodie tremblay".encode()).hexdigest(), "42"]


def test_split_fullname(spark):
    df = spark.createDataFrame([("Dupont, Jean",), ("Jean Pierre Dupont",), ("Madonna",)], "v string")
    got = [tuple(r) for r in df.select(N.split_fullname("v").alias("s")).select("s.nom", "s.prenom").collect()]
    assert got == [("Dupont", "Jean"), ("Dupont", "Jean Pierre"), ("Madonna", "Inconnu")]


def test_transforms(spark):
    df = spark.createDataFrame([("  jean-pierre   dupont 6 ",)], "v string")
    out = N.apply_transforms(df, {"v": ["strip", "collapse_spaces", "drop_trailing_digit", "title_keep_hyphen"]})
    assert out.first()[0] == "Jean-Pierre dupont"


def test_clean_name_and_upper(spark):
    assert one(spark, N.clean_name(F.col("v")), ["nan", "Prénom", " ", "Marie"]) == [None, None, None, "Marie"]
    assert one(spark, N.is_upper_name(F.col("v")), ["DUPONT, JEAN", "Dupont, Jean", "1234", None]) == \
        [True, False, False, False]


def test_business_key_matches_md5_of_parts(spark):
    import hashlib
    df = spark.createDataFrame([(dt.date(2025, 8, 28), "1001", "SAL", None, 500000, 75000)],
                               "d date, m string, c string, p string, a long, e long")
    got = df.select(business_key("d", "m", "c", F.coalesce("p", F.lit("N/A")), "a", "e")).first()[0]
    assert got == hashlib.md5(b"2025-08-28|1001|SAL|N/A|500000|75000").hexdigest()


def test_display_formats(spark):
    from paysift.functions.formatting import money_fr, number_fr, percent_fr
    df = spark.createDataFrame([(1234.56, 1234567, 12.345), (-0.5, 12, 0.0)], "m double, n long, p double")
    got = [tuple(r) for r in df.select(money_fr("m"), number_fr("n"), percent_fr("p")).collect()]
    assert got == [("1 234.56 $", "1\u202f234\u202f567", "12.3%"), ("-0.50 $", "12", "0.0%")]
