"""KPI queries F1-F13 over the fixture ledger."""

from __future__ import annotations

from paysift.operators import kpi
from paysift.sources import fixtures as fx
from paysift.sources.params import params

from .catalog import query
from .quality_plans import CODEDIM_CTE, STAGED_CTE, STAMPED_FACT_CTE, loaded_fact
from .sqltext import CONTRACT_INNER, NB_EMP_NONZERO, STAR_INNER, STAR_OUTER, contract_outer

PARAMS_CTE = """params AS (
  SELECT * FROM (VALUES ('part_employeur_taux', CAST(0.15 AS DOUBLE), CAST(NULL AS VARCHAR)),
    ('use_sign_fallback', CAST(1 AS DOUBLE), CAST(NULL AS VARCHAR)))
    AS v(param_key, value_num, value_text))"""


@query("f01_kpi_cards", f"""
SELECT max(pay_date) AS date_paie,
  coalesce(CAST(SUM(amount_cents) AS DOUBLE)/100.0, 0.0) AS salaire_net_total,
  coalesce(CAST(SUM(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0, 0.0) AS masse_salariale,
  coalesce(CAST(SUM(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0, 0.0) AS deductions,
  CASE WHEN COUNT(DISTINCT employee_id) > 0
       THEN CAST(SUM(amount_cents) AS DOUBLE)/100.0/COUNT(DISTINCT employee_id) ELSE 0.0 END AS net_moyen,
  COUNT(DISTINCT employee_id) AS nb_employes, COUNT(*) AS nb_transactions
FROM ledger WHERE pay_date = (SELECT max(pay_date) FROM ledger)
""")
def f01(spark, sf):
    return kpi.kpi_cards(fx.ledger(spark, sf))


@query("f02_kpi_by_period", f"""
SELECT date_paie, {contract_outer()}, nb_employes FROM (
  SELECT pay_date AS date_paie, {CONTRACT_INNER}, {NB_EMP_NONZERO}
  FROM ledger GROUP BY pay_date) t
""")
def f02(spark, sf):
    return kpi.kpi_by_period(fx.ledger(spark, sf))


@query("f03_kpi_by_category", f"""
SELECT date_paie, categorie_emploi, {contract_outer()}, nb_employes FROM (
  SELECT t.pay_date AS date_paie, coalesce(e.categorie_emploi, 'Non défini') AS categorie_emploi,
    {CONTRACT_INNER.replace('amount_cents', 't.amount_cents').replace('pay_code', 't.pay_code')},
    COUNT(DISTINCT CASE WHEN t.amount_cents <> 0 THEN t.employee_id END) AS nb_employes
  FROM ledger t LEFT JOIN employees e ON t.employee_id = e.employee_id
  GROUP BY t.pay_date, e.categorie_emploi) x
""")
def f03(spark, sf):
    return kpi.kpi_by_category(fx.ledger(spark, sf), fx.employees(spark, sf))


@query("f04_kpi_by_code", f"""
SELECT date_paie, pay_code, {contract_outer()}, nb_employes FROM (
  SELECT pay_date AS date_paie, pay_code, {CONTRACT_INNER}, {NB_EMP_NONZERO}
  FROM ledger GROUP BY pay_date, pay_code) t
""")
def f04(spark, sf):
    return kpi.kpi_by_code(fx.ledger(spark, sf))


@query("f05_kpi_by_post", f"""
SELECT date_paie, poste_budgetaire, {contract_outer()}, nb_employes FROM (
  SELECT pay_date AS date_paie, coalesce(budget_post, 'Non défini') AS poste_budgetaire,
    {CONTRACT_INNER}, {NB_EMP_NONZERO}
  FROM ledger GROUP BY pay_date, coalesce(budget_post, 'Non défini')) t
""")
def f05(spark, sf):
    return kpi.kpi_by_post(fx.ledger(spark, sf))


@query("f06_kpi_by_employee", f"""
SELECT date_paie, employee_id, {contract_outer()}, CAST(1 AS BIGINT) AS nb_employes FROM (
  SELECT pay_date AS date_paie, employee_id, {CONTRACT_INNER}
  FROM ledger GROUP BY pay_date, employee_id) t
""")
def f06(spark, sf):
    return kpi.kpi_by_employee(fx.ledger(spark, sf))


@query("f07_kpi_month", f"""
SELECT mois, annee, {contract_outer()}, nb_employes, nb_dates_paie, nb_transactions FROM (
  SELECT strftime(pay_date, '%Y-%m') AS mois, strftime(pay_date, '%Y') AS annee, {CONTRACT_INNER},
    {NB_EMP_NONZERO}, COUNT(DISTINCT pay_date) AS nb_dates_paie, COUNT(*) AS nb_transactions
  FROM ledger GROUP BY 1, 2) t
""")
def f07(spark, sf):
    return kpi.kpi_month(fx.ledger(spark, sf))


@query("f08_kpi_year", f"""
SELECT annee, {contract_outer()}, nb_employes, nb_dates_paie, nb_mois, nb_transactions FROM (
  SELECT strftime(pay_date, '%Y') AS annee, {CONTRACT_INNER}, {NB_EMP_NONZERO},
    COUNT(DISTINCT pay_date) AS nb_dates_paie, COUNT(DISTINCT strftime(pay_date, '%Y-%m')) AS nb_mois,
    COUNT(*) AS nb_transactions
  FROM ledger GROUP BY 1) t
""")
def f08(spark, sf):
    return kpi.kpi_year(fx.ledger(spark, sf))


@query("f09_kpi_month_category", """
SELECT mois, substr(mois, 1, 4) AS annee, categorie_emploi,
  CAST(_pos AS DOUBLE)/100.0 AS gains_brut, CAST(_neg AS DOUBLE)/100.0 AS deductions_net,
  CAST(_net AS DOUBLE)/100.0 AS net_a_payer, CAST(_pos AS DOUBLE)*0.15/100.0 AS part_employeur,
  (CAST(_net AS DOUBLE) + CAST(_pos AS DOUBLE)*0.15)/100.0 AS cout_total, nb_employes, nb_transactions
FROM (
  SELECT strftime(t.pay_date, '%Y-%m') AS mois, coalesce(e.categorie_emploi, 'Non défini') AS categorie_emploi,
    CAST(SUM(CASE WHEN t.amount_cents > 0 THEN t.amount_cents ELSE 0 END) AS BIGINT) AS _pos,
    CAST(SUM(CASE WHEN t.amount_cents < 0 THEN t.amount_cents ELSE 0 END) AS BIGINT) AS _neg,
    CAST(SUM(t.amount_cents) AS BIGINT) AS _net,
    COUNT(DISTINCT CASE WHEN t.amount_cents <> 0 THEN t.employee_id END) AS nb_employes,
    COUNT(*) AS nb_transactions
  FROM ledger t LEFT JOIN employees e ON t.employee_id = e.employee_id
  GROUP BY 1, e.categorie_emploi) x
""")
def f09(spark, sf):
    return kpi.kpi_month_category(fx.ledger(spark, sf), fx.employees(spark, sf))


STAR_CTES = STAGED_CTE + ",\n" + CODEDIM_CTE + ",\n" + STAMPED_FACT_CTE


@query("f10_kpi_star", f"""
SELECT date_paie, strftime(date_paie, '%Y-%m') AS mois_paie, CAST(year(date_paie) AS INT) AS annee_paie,
  CAST(quarter(date_paie) AS INT) AS trimestre, {STAR_OUTER} FROM (
  SELECT pay_date AS date_paie, {STAR_INNER} FROM stamped GROUP BY pay_date) t
""", ctes=STAR_CTES)
def f10(spark, sf):
    return kpi.kpi_star(loaded_fact(spark, sf))


@query("f11_kpi_star_month", f"""
SELECT mois_paie, CAST(substr(mois_paie, 1, 4) AS INT) AS annee_paie, derniere_mise_a_jour, {STAR_OUTER} FROM (
  SELECT strftime(pay_date, '%Y-%m') AS mois_paie, max(loaded_at) AS derniere_mise_a_jour, {STAR_INNER} FROM stamped GROUP BY 1) t
""", ctes=STAR_CTES)
def f11(spark, sf):
    return kpi.kpi_star_month(loaded_fact(spark, sf))


@query("f12_kpi_param_rate", f"""
SELECT date_paie, CAST(_pos AS DOUBLE)/100.0 AS gains_brut, CAST(_net AS DOUBLE)/100.0 AS net_a_payer,
  CAST(_pos AS DOUBLE)*r/100.0 AS part_employeur, (CAST(_net AS DOUBLE) + CAST(_pos AS DOUBLE)*r)/100.0 AS cout_total,
  nb_employes
FROM (SELECT pay_date AS date_paie, {CONTRACT_INNER}, {NB_EMP_NONZERO} FROM ledger GROUP BY pay_date) t,
  (SELECT coalesce(max(value_num), 0.15) AS r FROM params WHERE param_key = 'part_employeur_taux') p
""", ctes=PARAMS_CTE)
def f12(spark, sf):
    return kpi.kpi_param_rate(fx.ledger(spark, sf), params(spark), key="part_employeur_taux")


@query("f13_kpi_employee_date", """
SELECT a.date_paie, e.matricule_norm AS matricule, coalesce(e.nom_complet, 'N/A') AS nom_prenom,
  coalesce(nullif(e.categorie_emploi, ''), 'Non défini') AS categorie_emploi,
  coalesce(nullif(e.titre_emploi, ''), 'Non défini') AS titre_emploi,
  coalesce(nullif(sa._post, ''), 'Non défini') AS poste_budgetaire,
  CAST(_pos AS DOUBLE)/100.0 AS gains_brut, CAST(_neg AS DOUBLE)/100.0 AS deductions,
  CAST(_net AS DOUBLE)/100.0 AS net, CAST(_pos AS DOUBLE)*0.15/100.0 AS part_employeur,
  CAST(CASE WHEN _net*100 + _pos*15 >= 0 THEN floor((_net*100 + _pos*15 + 50)/100)
            ELSE -floor((-(_net*100 + _pos*15) + 50)/100) END AS DOUBLE)/100.0 AS cout_total
FROM (SELECT pay_date AS date_paie, employee_id,
        CAST(SUM(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS _pos,
        CAST(SUM(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS _neg,
        CAST(SUM(amount_cents) AS BIGINT) AS _net
      FROM ledger GROUP BY pay_date, employee_id) a
JOIN employees e ON e.employee_id = a.employee_id
LEFT JOIN (SELECT pay_date AS date_paie, employee_id, max(nullif(budget_post, '')) AS _post
           FROM stg_lines GROUP BY pay_date, employee_id) sa
  ON sa.date_paie = a.date_paie AND sa.employee_id = a.employee_id
""")
def f13(spark, sf):
    return kpi.kpi_employee_date(fx.ledger(spark, sf), fx.employees(spark, sf), fx.stg_lines(spark, sf))

