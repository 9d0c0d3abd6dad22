"""Search queries I1-I8."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.operators import name_index as NI
from paysift.operators import search as S
from paysift.sources import fixtures as fx
from paysift.sources.sinks import stored, work_dir

from .analytics_plans import CANON_CTE, canon
from .catalog import query
from .sqltext import norm_text

LEDGER_JOIN = """FROM ledger t JOIN employees e ON t.employee_id = e.employee_id
WHERE t.pay_code ILIKE '%' || '10' || '%'"""


@query("i01_ledger_page", f"""
SELECT e.matricule_norm, e.nom_complet AS nom, t.pay_date AS date_paie, t.pay_code AS categorie,
  CAST(t.amount_cents AS DOUBLE)/100.0 AS montant, t.source_row_no
{LEDGER_JOIN}
ORDER BY t.pay_date DESC, e.matricule_norm, t.source_row_no LIMIT 100 OFFSET 100
""")
def i01(spark, sf):
    return S.ledger_page(fx.ledger(spark, sf), fx.employees(spark, sf), categorie="10", limit=100, offset=100)


@query("i01_ledger_total", f"SELECT count(*) AS total {LEDGER_JOIN}")
def i01t(spark, sf):
    return S.ledger_count(fx.ledger(spark, sf), fx.employees(spark, sf), categorie="10")


@query("i02_search_lines", """
SELECT * FROM canon WHERE date_paie >= DATE '1996-01-01' AND date_paie <= DATE '1997-12-31'
  AND code_paie ILIKE '%AJUST%' AND poste_budgetaire ILIKE '0-00%'
""", ctes=CANON_CTE)
def i02(spark, sf):
    return S.search_lines(canon(spark, sf), "1996-01-01", "1997-12-31", code="AJUST", post="0-00")


@query("i03_search_employees", f"""
SELECT e.employee_id, e.matricule_norm, e.nom_complet, e.statut, l.derniere_paie
FROM employees e LEFT JOIN (SELECT employee_id, max(pay_date) AS derniere_paie FROM ledger GROUP BY 1) l
  ON l.employee_id = e.employee_id
WHERE contains({norm_text('e.nom_complet')}, {norm_text("'NOËL'")}) OR contains(e.matricule_norm, 'NOËL')
""")
def i03(spark, sf):
    return S.search_employees(fx.employees(spark, sf), fx.ledger(spark, sf), "NOËL")


@query("i03_indexed_search", f"""
SELECT e.employee_id, e.matricule_norm, e.nom_complet, e.statut, l.derniere_paie
FROM employees e LEFT JOIN (SELECT employee_id, max(pay_date) AS derniere_paie FROM ledger GROUP BY 1) l
  ON l.employee_id = e.employee_id
WHERE contains({norm_text('e.nom_complet')}, {norm_text("'NOËL'")}) OR contains(e.matricule_norm, 'NOËL')
""")
def i03_indexed(spark, sf):
    path = work_dir(spark, "names")
    NI.build_index(fx.employees(spark, sf), path)
    return NI.search_indexed(spark, path, fx.ledger(spark, sf), "NOËL")


@query("i04_indexed_list", f"""
SELECT * FROM employees WHERE statut = 'actif' AND contains({norm_text('nom_complet')}, {norm_text("'élo'")})
""")
def i04_indexed(spark, sf):
    path = work_dir(spark, "names")
    NI.build_index(fx.employees(spark, sf), path)
    return NI.list_indexed(spark, path, "élo", status="actif")


@query("i01_seek_pages", """
SELECT e.matricule_norm, e.nom_complet AS nom, t.pay_date, t.pay_code AS categorie, CAST(t.amount_cents AS DOUBLE)/100.0 AS montant,
  t.source_row_no, t.source_file
FROM ledger t JOIN employees e ON t.employee_id = e.employee_id
ORDER BY t.pay_date DESC, e.matricule_norm, t.source_row_no, t.source_file LIMIT 500
""")
def i01_seek(spark, sf):
    """Five pages of 100 lines, each from the cursor of the one before, over the stored ledger."""
    lg, emp = stored(fx.ledger(spark, sf), "seek", "pay_year"), fx.employees(spark, sf)
    per_date = stored(lg.groupBy("pay_date").agg(F.count(F.lit(1)).alias("n")), "per-date")
    pages, after = [], None
    for _ in range(5):
        pages.append(stored(S.ledger_page_after(lg, emp, after, 100, per_date), "page"))
        after = S.cursor_of(pages[-1])
        if after is None:
            break
    return fx.union_all(pages)


@query("i04_list_employees", """
SELECT * FROM employees WHERE statut = 'actif' AND categorie_emploi = 'BUILDING'
""")
def i04(spark, sf):
    return S.list_employees(fx.employees(spark, sf), status="actif", categorie="BUILDING")


@query("i05_employee_detail", """
SELECT p.employee_id, e.matricule_norm, e.nom_complet, e.statut, p.pay_date, CAST(p._n AS DOUBLE)/100.0 AS net, p.lignes
FROM (SELECT employee_id, pay_date, CAST(sum(amount_cents) AS BIGINT) AS _n, count(*) AS lignes FROM ledger
      WHERE employee_id = (SELECT min(employee_id) FROM ledger) GROUP BY 1, 2 ORDER BY pay_date DESC LIMIT 10) p
LEFT JOIN employees e ON e.employee_id = p.employee_id
""")
def i05(spark, sf):
    lg = fx.ledger(spark, sf)
    return S.employee_detail(lg, fx.employees(spark, sf), lg.agg(F.min("employee_id")).scalar())


@query("i06_latest_pay_date", """
SELECT coalesce(a, b) AS pay_date, CASE WHEN a IS NOT NULL THEN 'ledger' ELSE 'fallback' END AS source
FROM (SELECT max(pay_date) AS a FROM ledger) x, (SELECT max(pay_date) AS b FROM stg_lines) y
""")
def i06(spark, sf):
    return S.latest_pay_date(fx.ledger(spark, sf), fx.stg_lines(spark, sf))


@query("i07_pay_dates", """
SELECT d.pay_date, d.source_file, b.batch_id, b.status
FROM (SELECT DISTINCT pay_date, source_file FROM ledger) d LEFT JOIN batches b ON b.pay_date = d.pay_date
""")
def i07(spark, sf):
    return S.pay_dates(fx.ledger(spark, sf), fx.batches(spark, sf))


@query("i08_distinct_values", "SELECT DISTINCT titre_emploi FROM canon WHERE titre_emploi IS NOT NULL", ctes=CANON_CTE)
def i08(spark, sf):
    return S.distinct_values(canon(spark, sf), "titre_emploi")
