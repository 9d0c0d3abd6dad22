"""Ingestion on the small files the reference generates for its import checks (FIXTURES.md 1.1, 1.2)."""

import datetime as dt

from pyspark.sql import functions as F

from paysift.operators.cleaning import drop_marker_rows, injection_report
from paysift.sources.mapping import canonicalise_columns, preflight
from paysift.sources.payfile import FILE_HEADERS, read_pay_csv
from paysift.sources.sinks import work_dir
from paysift.streaming.ingest import stage_batch


def _write(spark, name, header, rows, sep=";", encoding="utf-8"):
    import os
    d = work_dir(spark, name)
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/file.csv", "w", encoding=encoding) as f:
        f.write(sep.join(header) + "\n")
        for r in rows:
            f.write(sep.join(r) + "\n")
    return d


def three_rows():
    base = ["1", "Cadre", "C01", "Analyste", "2025-11-20", None, None, "Gains", "SAL", "Salaire", "0-001-10-000", "",
            None, None, None]
    out = []
    for i, (mat, amt, emp, comb) in enumerate([("1001", "5000", "750", "5750"), ("1002", "4500", "675", "5175"),
                                               ("1003", "4800", "720", "5520")], 1):
        r = list(base)
        r[0], r[5], r[6], r[12], r[13], r[14] = str(i), mat, f"Employe{i}, Test", amt, emp, comb
        out.append(r)
    return out


def test_three_row_file_imports(spark):
    d = _write(spark, "three", FILE_HEADERS, three_rows())
    raw = read_pay_csv(spark, d)
    canon = canonicalise_columns(raw)
    assert canon.columns[:15] == ["numero_ligne", "categorie_emploi", "code_emploi", "titre_emploi", "date_paie",
                                  "matricule", "nom_employe", "categorie_paie", "code_paie", "description_code_paie",
                                  "poste_budgetaire", "description_poste_budgetaire", "montant_employe",
                                  "part_employeur", "montant_combine"]
    pf = preflight(canon.drop("file_path")).first()
    assert pf["ok"] and pf["n_rows"] == 3 and pf["n_months"] == 1
    staged = stage_batch(raw).orderBy("source_row_no").collect()
    assert [r["is_valid"] for r in staged] == [True, True, True]
    assert [r["amount_cents"] for r in staged] == [500000, 450000, 480000]
    assert [r["employer_cents"] for r in staged] == [75000, 67500, 72000]
    assert {r["pay_date"] for r in staged} == {dt.date(2025, 11, 20)}


def test_comma_separated_latin1_file(spark):
    hdr = ["matricule", "employé", "date de paie", "montant"]
    d = _write(spark, "latin1", hdr, [["1001", "Noël Tremblay", "20/11/2025", "1234.56"]], sep=",",
               encoding="latin-1")
    raw = read_pay_csv(spark, d)
    row = raw.first()
    assert row["employé"] == "Noël Tremblay" and row["montant"] == "1234.56"


def test_non_numeric_numbers_are_dropped(spark):
    # the 5-row generator uses MAT001..MAT005, which the cleaner drops as non-numeric
    rows = [[f"MAT00{i}", f"Employe {i}"] for i in range(1, 6)] + [["1001", "Vrai Employe"], ["", "Gains"]]
    df = spark.createDataFrame(rows, "matricule string, nom string")
    kept = drop_marker_rows(df, "nom", "matricule").collect()
    assert [r["matricule"] for r in kept] == ["1001"]


def test_staging_with_issues(spark):
    rows = [["1", "1001", "", "2025-08-28", "SAL", "1000,00"], ["2", "1002", "B", "INVALID", "SAL", "200,00"],
            ["3", "1003", "C", "2025-08-28", "SAL", "(500.00)"]]
    df = spark.createDataFrame(rows, "r string, mat string, nom string, d string, code string, amt string")
    from paysift.functions.amounts import amount_to_cents
    from paysift.functions.dates import parse_pay_date
    from paysift.operators.quality import validate_lines
    typed = df.select("r", "mat", F.trim("code").alias("code"), parse_pay_date("d").alias("pay_date"),
                      amount_to_cents("amt").alias("cents"), F.lit(0).alias("er"))
    v = validate_lines(typed, mat_col="mat", code_col="code", amount_col="cents", employer_col="er") \
        .orderBy("r").collect()
    assert [r["is_valid"] for r in v] == [True, False, True]
    assert v[1]["validation_errors"] == ["DATE_PAIE_MANQUANTE"]
    assert v[2]["cents"] == -50000


def test_formula_cells_are_reported(spark):
    df = spark.createDataFrame([("1001", "=A+B"), ("1002", "100,00"), ("=cmd", "5")], "matricule string, combine string")
    rep = {r["column"]: r["n_suspect"] for r in injection_report(df, ["matricule", "combine"]).collect()}
    assert rep == {"combine": 1, "matricule": 1}
