"""Stored KPI tables kept up to date by changed pay dates: equal to a full run over the whole ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.operators import refresh as RF
from paysift.sources import fixtures as fx
from paysift.sources import sinks as SK

from .catalog import query
from .sqltext import CONTRACT_INNER, NB_EMP_NONZERO, STAR_INNER, STAR_OUTER, contract_outer


def refreshed_after_import(spark, sf, name):
    """All dates from a first import, then the dates of a second one only; both imports make the ledger."""
    lines = SK.stored(fx.ledger(spark, sf), "refresh-lines", "pay_year")
    second = F.col("source_row_no") % 61 == 0
    out = SK.work_dir(spark, "refresh")
    first = lines.filter(~second)
    RF.refresh(first, first, RF.changed_dates(first), out)
    RF.refresh(lines, lines, RF.changed_dates(lines.filter(second)), out)
    return RF.refreshed(spark, out, name)


@query("m04_refresh_kpi_period", f"""
SELECT date_paie, {contract_outer()}, nb_employes FROM (
  SELECT pay_date AS date_paie, {CONTRACT_INNER}, {NB_EMP_NONZERO} FROM ledger GROUP BY pay_date) t
""")
def m04_period(spark, sf):
    return refreshed_after_import(spark, sf, "kpi_period").withColumnRenamed("pay_date", "date_paie")


@query("m04_refresh_kpi_star", f"""
SELECT date_paie, strftime(date_paie, '%Y-%m') AS mois_paie, CAST(year(date_paie) AS INT) AS annee_paie,
  CAST(quarter(date_paie) AS INT) AS trimestre, {STAR_OUTER} FROM (
  SELECT pay_date AS date_paie, {STAR_INNER} FROM (
    SELECT *, categorie_paie = 'Gains' AND amount_cents < 0 AS is_adjustment,
      categorie_paie IN ('Deductions', 'Deductions_legales', 'Assurances', 'Syndicats') AND amount_cents > 0 AS is_refund FROM ledger) l
  GROUP BY pay_date) t
""")
def m04_star(spark, sf):
    return refreshed_after_import(spark, sf, "kpi_star").withColumnRenamed("pay_date", "date_paie")
