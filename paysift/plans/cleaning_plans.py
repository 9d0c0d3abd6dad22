"""Cleaning queries B1-B25 over the raw-text and employee fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.functions import amounts as AM
from paysift.functions import dates as D
from paysift.functions import names as N
from paysift.functions.keys import business_key
from paysift.operators import cleaning as CL
from paysift.operators.lines import flag_lines
from paysift.sources import fixtures as fx
from paysift.sources.tables import read_table

from .analytics_plans import CANON_CTE, canon
from .catalog import query
from .sqltext import amount_cents, fix_ydm, norm_matricule, norm_text, parse_date

WLO, WHI = D.WIDE_YEAR_LO, D.WIDE_YEAR_HI


@query("b01_amount_to_cents", f"""
SELECT source_row_no, montant_raw, {amount_cents('montant_raw')} AS montant_cents FROM raw_lines
""")
def b01(spark, sf):
    r = fx.raw_lines(spark, sf)
    return r.select("source_row_no", "montant_raw", AM.amount_to_cents("montant_raw").alias("montant_cents"))


@query("b02_parse_pay_date", f"""
SELECT source_row_no, date_raw, {parse_date('date_raw', WLO, WHI)} AS date_paie,
  coalesce({parse_date('date_raw', WLO, WHI)} = pay_date, false) AS matches_expected
FROM raw_lines
""")
def b02(spark, sf):
    r = fx.raw_lines(spark, sf)
    d = D.parse_pay_date("date_raw", WLO, WHI)
    return r.select("source_row_no", "date_raw", d.alias("date_paie"),
                    F.coalesce(d == F.col("pay_date"), F.lit(False)).alias("matches_expected"))


@query("b03_excel_origin", f"""
SELECT n_serial, CASE WHEN n_serial > 0 THEN round(_ok1900 * 100.0 / n_serial, 6) END AS pct_1900,
  CASE WHEN n_serial > 0 THEN round(_ok1904 * 100.0 / n_serial, 6) END AS pct_1904,
  CASE WHEN _ok1904 > _ok1900 THEN '1904' ELSE '1900' END AS system
FROM (SELECT count(*) FILTER (WHERE regexp_matches(trim(date_raw), '^\\d{{4,6}}(\\.0+)?$')) AS n_serial,
        count(*) FILTER (WHERE regexp_matches(trim(date_raw), '^\\d{{4,6}}(\\.0+)?$')
          AND year(DATE '1899-12-30' + TRY_CAST(regexp_extract(trim(date_raw), '^(\\d+)', 1) AS INT)) BETWEEN {WLO} AND {WHI}) AS _ok1900,
        count(*) FILTER (WHERE regexp_matches(trim(date_raw), '^\\d{{4,6}}(\\.0+)?$')
          AND year(DATE '1904-01-01' + TRY_CAST(regexp_extract(trim(date_raw), '^(\\d+)', 1) AS INT)) BETWEEN {WLO} AND {WHI}) AS _ok1904
      FROM raw_lines) a
""")
def b03(spark, sf):
    return CL.excel_origin(fx.raw_lines(spark, sf), "date_raw", WLO, WHI)


@query("b04_fix_ydm", f"""
SELECT source_row_no, date_raw, {fix_ydm('date_raw')} AS date_fixed FROM raw_lines
""")
def b04(spark, sf):
    r = fx.raw_lines(spark, sf)
    return r.select("source_row_no", "date_raw", D.fix_ydm("date_raw").alias("date_fixed"))


@query("b05_sanitise_dates", f"""
SELECT count(*) AS total, count(d) FILTER (WHERE year(d) BETWEEN 2000 AND 2050) AS valid,
  count(*) FILTER (WHERE d IS NOT NULL AND NOT (year(d) BETWEEN 2000 AND 2050)) AS rejected
FROM (SELECT {parse_date('date_raw', 1, 9999)} AS d FROM raw_lines) x
""")
def b05(spark, sf):
    r = fx.raw_lines(spark, sf).select(D.parse_pay_date("date_raw", 1, 9999).alias("d"))
    return CL.date_stats(CL.sanitise_dates(r, "d", D.YEAR_LO, D.YEAR_HI), "d")


def _date_report_sql(cols, lo, hi):
    parts = []
    for c in cols:
        v = f"trim(CAST({c} AS VARCHAR))"
        p = parse_date(v, lo, hi)
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS total,
  count(*) FILTER (WHERE regexp_matches({v}, '^\\d{{4,6}}(\\.0+)?$')) AS numeric,
  count(*) FILTER (WHERE {v} IS NOT NULL AND NOT regexp_matches({v}, '^\\d{{4,6}}(\\.0+)?$')) AS text,
  count(*) FILTER (WHERE {p} IS NOT NULL) AS parsed,
  count(*) FILTER (WHERE {v} IS NOT NULL AND {p} IS NULL) AS failed,
  round((count(*) FILTER (WHERE {p} IS NOT NULL)) * 100.0 / count(*), 6) AS pct_valid
FROM raw_lines""")
    return "\nUNION ALL\n".join(parts)


@query("b06_date_column_report", _date_report_sql(["date_raw", "montant_raw"], WLO, WHI))
def b06(spark, sf):
    return CL.date_column_report(fx.raw_lines(spark, sf), ["date_raw", "montant_raw"], WLO, WHI)


@query("b07_detect_date_columns", f"""
SELECT "column", reason, ratio, reason IS NOT NULL AS is_date FROM (
  SELECT "column", ratio,
    CASE WHEN regexp_matches("column", '(?i)(date|jour|periode|période|day)') THEN 'name'
         WHEN "column" = 'pay_date' THEN 'type'
         WHEN ratio >= 0.6 THEN 'values' END AS reason
  FROM (SELECT 'montant_raw' AS "column", round(avg(CASE WHEN {parse_date('montant_raw', WLO, WHI)} IS NOT NULL THEN 1 ELSE 0 END), 6) AS ratio FROM raw_lines
        UNION ALL
        SELECT 'source_row_no', round(avg(CASE WHEN {parse_date('CAST(source_row_no AS VARCHAR)', WLO, WHI)} IS NOT NULL THEN 1 ELSE 0 END), 6) FROM raw_lines
        UNION ALL
        SELECT 'pay_date', round(avg(CASE WHEN {parse_date('CAST(pay_date AS VARCHAR)', WLO, WHI)} IS NOT NULL THEN 1 ELSE 0 END), 6) FROM raw_lines) r) x
""")
def b07(spark, sf):
    return CL.detect_date_columns(fx.raw_lines(spark, sf), ["montant_raw", "source_row_no", "pay_date"])


# noisy spellings of the raw number: '#001 23', as is, 'no 00123'
NOISY = """CASE employee_id % 3 WHEN 0 THEN concat('#', substr(trim(matricule_raw), 1, 3), ' ', substr(trim(matricule_raw), 4))
  WHEN 1 THEN concat(trim(matricule_raw), '.') ELSE matricule_raw END"""


@query("b08_norm_matricule", f"""
SELECT employee_id, noisy, {norm_matricule('noisy')} AS matricule_norm FROM (SELECT employee_id, {NOISY} AS noisy FROM employees) n
""")
def b08(spark, sf):
    e = fx.employees(spark, sf).select("employee_id", F.expr(NOISY).alias("noisy"))
    return e.select("employee_id", "noisy", N.norm_matricule("noisy").alias("matricule_norm"))


@query("b09_employee_key", f"""
SELECT employee_id, coalesce(nullif({norm_matricule('noisy')}, ''), md5({norm_text('nom_complet')})) AS employee_key
FROM (SELECT *, CASE WHEN employee_id % 5 = 0 THEN ' # ' ELSE {NOISY} END AS noisy FROM employees) n
""")
def b09(spark, sf):
    noisy = F.when(F.col("employee_id") % 5 == 0, F.lit(" # ")).otherwise(F.expr(NOISY))
    e = fx.employees(spark, sf).withColumn("noisy", noisy)
    return e.select("employee_id", N.employee_key("noisy", "nom_complet").alias("employee_key"))


@query("b10_norm_text", f"""
SELECT employee_id, nom_complet, {norm_text('nom_complet')} AS nom_norm FROM employees
""")
def b10(spark, sf):
    e = fx.employees(spark, sf)
    return e.select("employee_id", "nom_complet", N.norm_text("nom_complet").alias("nom_norm"))


@query("b11_split_fullname", f"""
SELECT employee_id, nom, CASE WHEN prenom = '' THEN 'Inconnu' ELSE prenom END AS prenom,
  {norm_text('nom')} AS nom_norm, CASE WHEN prenom = '' THEN 'inconnu' ELSE {norm_text('prenom')} END AS prenom_norm
FROM (SELECT employee_id,
        CASE WHEN contains(trim(nom_complet), ',') THEN trim(split_part(trim(nom_complet), ',', 1))
             WHEN len(string_split_regex(trim(nom_complet), '\\s+')) >= 2
               THEN string_split_regex(trim(nom_complet), '\\s+')[-1] ELSE trim(nom_complet) END AS nom,
        CASE WHEN contains(trim(nom_complet), ',') THEN trim(substr(trim(nom_complet), instr(trim(nom_complet), ',') + 1))
             WHEN len(string_split_regex(trim(nom_complet), '\\s+')) >= 2
               THEN array_to_string(string_split_regex(trim(nom_complet), '\\s+')[1:-2], ' ') ELSE '' END AS prenom
      FROM employees) x
""")
def b11(spark, sf):
    e = fx.employees(spark, sf)
    s = N.split_fullname("nom_complet")
    return e.select("employee_id", s["nom"].alias("nom"), s["prenom"].alias("prenom"),
                    s["nom_norm"].alias("nom_norm"), s["prenom_norm"].alias("prenom_norm"))


@query("b12_apply_transforms", """
SELECT employee_id,
  array_to_string(list_transform(string_split(trim(trim(regexp_replace(coalesce(nom_complet, ''), '\\s+', ' ', 'g'))), '-'),
    lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '-') AS nom_complet,
  upper(trim(coalesce(categorie_emploi, ''))) AS categorie_emploi,
  upper(substr(trim(lower(coalesce(titre_emploi, ''))), 1, 1)) || substr(trim(lower(coalesce(titre_emploi, ''))), 2)
    AS titre_emploi
FROM employees
""")
def b12(spark, sf):
    e = fx.employees(spark, sf).select("employee_id", "nom_complet", "categorie_emploi", "titre_emploi")
    return N.apply_transforms(e, {"nom_complet": ["strip", "collapse_spaces", "title_keep_hyphen"],
                                  "categorie_emploi": ["strip", "upper"],
                                  "titre_emploi": ["lower", "sentence"]})


@query("b13_norm_currency", """
SELECT source_row_no, tok AS devise_raw,
  CASE upper(trim(tok)) WHEN '$' THEN 'CAD' WHEN 'C$' THEN 'CAD' WHEN 'CA$' THEN 'CAD' WHEN 'CAD' THEN 'CAD'
    WHEN 'USD' THEN 'USD' WHEN 'EUR' THEN 'EUR' ELSE upper(trim(tok)) END AS devise
FROM (SELECT source_row_no, regexp_extract(montant_raw, '(CA\\$|C\\$|CAD|USD|EUR|\\$)', 1) AS tok FROM raw_lines) x
""")
def b13(spark, sf):
    r = fx.raw_lines(spark, sf).select("source_row_no", AM.currency_token("montant_raw").alias("devise_raw"))
    return r.select("source_row_no", "devise_raw", AM.norm_currency("devise_raw").alias("devise"))


@query("b14_clean_name", """
SELECT employee_id,
  CASE WHEN trim(nom_complet) IS NULL OR lower(trim(nom_complet)) IN ('nan','nom','prénom','prenom','none','') THEN NULL
       ELSE trim(nom_complet) END AS nom_clean,
  CASE WHEN trim(categorie_emploi) IS NULL OR lower(trim(categorie_emploi)) IN ('nan','nom','prénom','prenom','none','') THEN NULL
       ELSE trim(categorie_emploi) END AS categorie_clean
FROM employees
""")
def b14(spark, sf):
    e = fx.employees(spark, sf)
    return e.select("employee_id", N.clean_name("nom_complet").alias("nom_clean"),
                    N.clean_name("categorie_emploi").alias("categorie_clean"))


@query("b15_drop_marker_rows", f"""
SELECT * FROM employees
WHERE {norm_text('nom_complet')} NOT IN ('gains','deductions','déductions','deductions legales','assurances',
  'syndicats','total','sous-total') AND regexp_matches(trim(matricule_raw), '^\\d+$')
""")
def b15(spark, sf):
    return CL.drop_marker_rows(fx.employees(spark, sf), "nom_complet", "matricule_raw")


@query("b16_drop_empty", "SELECT * FROM employees")
def b16(spark, sf):
    """The employees with a column that is always null and, between them, rows that are null throughout."""
    emp = fx.employees(spark, sf).withColumn("vide", F.lit(None).cast("string"))
    blank = emp.filter("employee_id % 50 = 0").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in emp.schema])
    return CL.drop_empty(emp.unionByName(blank))


@query("b17_strict_decimal", """
SELECT source_row_no, CASE WHEN regexp_matches(trim(montant_raw), '^-?[0-9]+(\\.[0-9]+)?$')
  THEN TRY_CAST(trim(montant_raw) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS montant
FROM raw_lines
""")
def b17(spark, sf):
    r = fx.raw_lines(spark, sf)
    return r.select("source_row_no", AM.strict_decimal("montant_raw").alias("montant"))


@query("b18_apply_sign_policy", """
SELECT l.source_row_no, l.pay_code, l.amount_cents * coalesce(p.employee_sign, 1) AS amount_cents,
  l.employer_cents * coalesce(p.employer_sign, 1) AS employer_cents
FROM ledger l LEFT JOIN sign_policies p ON p.pay_code = l.pay_code
""")
def b18(spark, sf):
    out = CL.apply_sign_policy(fx.ledger(spark, sf), fx.sign_policies(spark))
    return out.select("source_row_no", "pay_code", F.col("amount_cents").cast("long").alias("amount_cents"),
                      F.col("employer_cents").cast("long").alias("employer_cents"))


@query("b19_is_upper_name", """
SELECT employee_id, nom_complet, coalesce(nom_complet = upper(nom_complet) AND regexp_matches(nom_complet, '[A-Za-z]'), false)
  AS is_inactive
FROM employees
""")
def b19(spark, sf):
    e = fx.employees(spark, sf)
    return e.select("employee_id", "nom_complet", N.is_upper_name("nom_complet").alias("is_inactive"))


@query("b20_flag_lines", """
SELECT source_file, source_row_no, montant_combine = 0 AS is_meta_row,
  nom_employe = upper(nom_employe) AND regexp_matches(nom_employe, '[A-Za-z]') AS is_inactive,
  strftime(date_paie, '%Y-%m-%d') AS pay_date_str, strftime(date_paie, '%Y-%m') AS period
FROM canon
""", ctes=CANON_CTE)
def b20(spark, sf):
    return flag_lines(canon(spark, sf)).select("source_file", "source_row_no", "is_meta_row", "is_inactive",
                                               "pay_date_str", "period")


@query("b21_pseudonymise", """
SELECT e.employee_id, r.pseudo FROM employees e LEFT JOIN (
  SELECT matricule_norm, printf('E-%04d', row_number() OVER (ORDER BY matricule_norm)) AS pseudo
  FROM (SELECT DISTINCT matricule_norm FROM employees WHERE matricule_norm IS NOT NULL) d) r
  ON r.matricule_norm = e.matricule_norm
""")
def b21(spark, sf):
    return CL.pseudonymise(fx.employees(spark, sf), "matricule_norm", "E-%04d").select("employee_id", "pseudo")


@query("b22_injection_report", """
SELECT "column", count(*) AS n_suspect, min(value) AS example FROM (
  SELECT 'nom_employe' AS "column", nom_employe AS value FROM canon UNION ALL
  SELECT 'code_paie', code_paie FROM canon UNION ALL
  SELECT 'poste_budgetaire', poste_budgetaire FROM canon UNION ALL
  SELECT 'categorie_emploi', categorie_emploi FROM canon) u
WHERE regexp_matches(value, '^[=+@|]') GROUP BY 1
""", ctes=CANON_CTE)
def b22(spark, sf):
    return CL.injection_report(canon(spark, sf),
                               ["nom_employe", "code_paie", "poste_budgetaire", "categorie_emploi"])


@query("b23_default_label", """
SELECT employee_id, coalesce(nullif(trim(categorie_emploi), ''), 'Non défini') AS categorie_emploi,
  coalesce(nullif(trim(titre_emploi), ''), 'N/A') AS titre_emploi
FROM employees
""")
def b23(spark, sf):
    e = fx.employees(spark, sf)
    return e.select("employee_id", N.default_label("categorie_emploi").alias("categorie_emploi"),
                    N.default_label("titre_emploi", N.LABEL_NA).alias("titre_emploi"))


IPM_CTE = """ipm AS (
  SELECT l.source_file, l.source_row_no, c.c_mktsegment AS categorie_emploi, n.n_name AS titre_emploi
  FROM ledger l JOIN customer c ON c.c_custkey = l.employee_id JOIN nation n ON n.n_nationkey = c.c_nationkey)"""


def ipm(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (fx.ledger(spark, sf).join(c, F.col("employee_id") == F.col("c_custkey"))
            .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("source_file", "source_row_no", F.col("c_mktsegment").alias("categorie_emploi"),
                    F.col("n_name").alias("titre_emploi")))


@query("b24_fill_blanks", """
SELECT s.source_file, s.source_row_no,
  coalesce(nullif(trim(s.categorie_emploi), ''), trim(i.categorie_emploi)) AS categorie_emploi,
  coalesce(nullif(trim(s.titre_emploi), ''), trim(i.titre_emploi)) AS titre_emploi
FROM canon s LEFT JOIN ipm i ON i.source_file = s.source_file AND i.source_row_no = s.source_row_no
""", ctes=CANON_CTE + ",\n" + IPM_CTE)
def b24(spark, sf):
    stg = canon(spark, sf).select("source_file", "source_row_no", "categorie_emploi", "titre_emploi")
    return CL.fill_blanks(stg, ipm(spark, sf), ["source_file", "source_row_no"], ["categorie_emploi", "titre_emploi"])


@query("b25_typed_fields", f"""
SELECT source_row_no, {amount_cents('montant_raw')} AS montant_raw_cents, {parse_date('date_raw', WLO, WHI)} AS date_raw_date FROM raw_lines
""")
def b25t(spark, sf):
    typed, _ = CL.convert_fields(fx.raw_lines(spark, sf), ["source_row_no"], ["montant_raw"], ["date_raw"])
    return typed.select("source_row_no", "montant_raw_cents", "date_raw_date")


@query("b25_convert_fields", f"""
SELECT source_row_no, 'montant_raw' AS "column", montant_raw AS raw_value, 'invalid_amount' AS alert_type
FROM raw_lines WHERE montant_raw IS NOT NULL AND trim(montant_raw) <> '' AND {amount_cents('montant_raw')} IS NULL
UNION ALL
SELECT source_row_no, 'date_raw', date_raw, 'invalid_date'
FROM raw_lines WHERE date_raw IS NOT NULL AND trim(date_raw) <> '' AND {parse_date('date_raw', WLO, WHI)} IS NULL
""")
def b25(spark, sf):
    _, alerts = CL.convert_fields(fx.raw_lines(spark, sf), ["source_row_no"], ["montant_raw"], ["date_raw"])
    return alerts


@query("e06_business_key", """
SELECT source_row_no, md5(concat_ws('|', coalesce(CAST(pay_date AS VARCHAR), ''), coalesce(CAST(employee_id AS VARCHAR), ''),
  coalesce(pay_code, ''), coalesce(coalesce(budget_post, 'N/A'), ''), coalesce(CAST(amount_cents AS VARCHAR), '0'),
  coalesce(CAST(employer_cents AS VARCHAR), '0'))) AS cle_metier
FROM ledger
""")
def e06(spark, sf):
    lg = fx.ledger(spark, sf)
    return lg.select("source_row_no", business_key("pay_date", "employee_id", "pay_code",
                                                   F.coalesce("budget_post", F.lit("N/A")), "amount_cents",
                                                   "employer_cents").alias("cle_metier"))
