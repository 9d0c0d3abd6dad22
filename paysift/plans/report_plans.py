"""Report queries F35-F64 over canonical lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.operators import reports as R
from paysift.sources import fixtures as fx

from .analytics_plans import CANON_CTE, canon, canon_lines
from .catalog import query

INACTIVE = "coalesce(nom_employe = upper(nom_employe) AND regexp_matches(nom_employe, '[A-Za-z]'), false)"
HS = "regexp_matches(lower(code_paie), 'heures sup|overtime|hs|heure sup|temps supp')"
MK_CTE = CANON_CTE + f""",
mk AS (
  SELECT strftime(date_paie, '%Y-%m') AS period,
    CAST(sum(CASE WHEN montant_employe >= 0 THEN montant_employe ELSE 0 END) AS BIGINT) AS masse_cents,
    CAST(sum(montant_employe) AS BIGINT) AS net_cents,
    CAST(sum(CASE WHEN montant_employe < 0 THEN montant_employe ELSE 0 END) AS BIGINT) AS ded_cents,
    CAST(sum(part_employeur) AS BIGINT) AS part_cents,
    count(DISTINCT CASE WHEN NOT {INACTIVE} THEN matricule END) AS effectifs,
    count(DISTINCT matricule) AS nb_employes,
    CAST(sum(CASE WHEN {HS} THEN montant_employe ELSE 0 END) AS BIGINT) AS hs_cents,
    count(*) FILTER (WHERE {HS}) AS hs_lines
  FROM canon GROUP BY 1),
mv AS (
  SELECT c.period, p.period AS p_period,
    CAST(c.masse_cents AS DOUBLE)/100.0 AS masse, CAST(p.masse_cents AS DOUBLE)/100.0 AS pmasse,
    CAST(c.net_cents AS DOUBLE)/100.0 AS net, CAST(p.net_cents AS DOUBLE)/100.0 AS pnet,
    abs(CAST(c.ded_cents AS DOUBLE)/100.0) AS ded, abs(CAST(p.ded_cents AS DOUBLE)/100.0) AS pded,
    CAST(c.masse_cents AS DOUBLE)/100.0 + CAST(c.part_cents AS DOUBLE)/100.0 AS cost,
    CAST(p.masse_cents AS DOUBLE)/100.0 + CAST(p.part_cents AS DOUBLE)/100.0 AS pcost,
    abs(CAST(c.net_cents AS DOUBLE)/100.0) / nullif(c.nb_employes, 0) AS avg_cost,
    abs(CAST(p.net_cents AS DOUBLE)/100.0) / nullif(p.nb_employes, 0) AS pavg_cost,
    CAST(c.effectifs AS DOUBLE) AS eff, CAST(p.effectifs AS DOUBLE) AS peff,
    CAST(c.hs_cents AS DOUBLE)/100.0 AS hs, CAST(p.hs_cents AS DOUBLE)/100.0 AS phs, c.hs_lines
  FROM mk c LEFT JOIN mk p ON p.period = strftime(CAST(c.period || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m'))"""


def _trend(c, p):
    d = f"(({c} - {p}) / {p} * 100)"
    return (f"CASE WHEN {p} IS NULL OR {p} = 0 THEN 'neutral' WHEN abs({d}) < 1.0 THEN 'neutral' "
            f"WHEN {d} > 0 THEN 'up' ELSE 'down' END")


def _alert(c, p, w, cr):
    d = f"abs(({c} - {p}) / {p} * 100)"
    return (f"CASE WHEN {p} IS NULL OR {p} = 0 THEN 'ok' WHEN {d} >= {cr} THEN 'critical' "
            f"WHEN {d} >= {w} THEN 'warning' ELSE 'ok' END")


def _pct(c, p, cond, denom=None):
    return f"CASE WHEN p_period IS NOT NULL AND ({cond}) THEN ({c} - {p}) / {denom or p} * 100 ELSE 0.0 END"


def _kpi_row(kid, cur, prev, delta, trend, alert):
    return (f"SELECT period, '{kid}' AS kpi_id, {cur} AS value, {prev} AS previous, round({delta}, 6) AS delta_pct, "
            f"{trend} AS trend, {alert} AS alert_level FROM mv")


HS_OK = "phs <> 0 AND hs_lines > 0"
DELTAS_SQL = "\nUNION ALL\n".join([
    _kpi_row("masse_salariale", "masse", "pmasse", _pct("masse", "pmasse", "pmasse > 0"),
             f"CASE WHEN p_period IS NOT NULL AND pmasse > 0 THEN {_trend('masse', 'pmasse')} ELSE 'neutral' END",
             f"CASE WHEN p_period IS NOT NULL AND pmasse > 0 THEN {_alert('masse', 'pmasse', 10.0, 20.0)} ELSE 'ok' END"),
    _kpi_row("salaire_net", "net", "pnet", _pct("net", "pnet", "pnet <> 0", "abs(pnet)"),
             f"CASE WHEN p_period IS NOT NULL AND pnet <> 0 THEN {_trend('net', 'pnet')} ELSE 'neutral' END", "'ok'"),
    _kpi_row("deductions", "ded", "pded", _pct("ded", "pded", "pded <> 0"),
             f"CASE WHEN p_period IS NULL OR pded = 0 THEN 'neutral' WHEN {_pct('ded', 'pded', 'pded <> 0')} > 1 THEN 'down' "
             f"WHEN {_pct('ded', 'pded', 'pded <> 0')} < -1 THEN 'up' ELSE 'neutral' END",
             f"CASE WHEN p_period IS NOT NULL AND pded <> 0 THEN {_alert('ded', 'pded', 15.0, 25.0)} ELSE 'ok' END"),
    _kpi_row("effectifs", "eff", "peff", _pct("eff", "peff", "peff > 0"),
             f"CASE WHEN p_period IS NOT NULL AND peff > 0 THEN {_trend('eff', 'peff')} ELSE 'neutral' END", "'ok'"),
    _kpi_row("cout_employeur", "cost", "pcost", _pct("cost", "pcost", "pcost > 0"),
             f"CASE WHEN p_period IS NOT NULL AND pcost > 0 THEN {_trend('cost', 'pcost')} ELSE 'neutral' END", "'ok'"),
    _kpi_row("cout_moyen", "coalesce(avg_cost, 0.0)", "pavg_cost", _pct("avg_cost", "pavg_cost", "pavg_cost > 0"),
             f"CASE WHEN p_period IS NOT NULL AND pavg_cost > 0 THEN {_trend('avg_cost', 'pavg_cost')} ELSE 'neutral' END",
             "'ok'"),
    _kpi_row("heures_sup", "abs(hs)", "phs", _pct("hs", "phs", HS_OK, "abs(phs)"),
             f"CASE WHEN p_period IS NOT NULL AND {HS_OK} THEN {_trend('hs', 'phs')} ELSE 'neutral' END",
             f"CASE WHEN p_period IS NOT NULL AND {HS_OK} AND {_pct('hs', 'phs', HS_OK, 'abs(phs)')} > 20.0 "
             f"THEN 'warning' ELSE 'ok' END"),
])
DELTAS_CTE = MK_CTE + ",\ndeltas AS (\n" + DELTAS_SQL + ")"


def deltas(spark, sf):
    return R.kpi_with_delta(canon_lines(spark, sf), fx.employees(spark, sf))


@query("f35_kpi_with_delta", "SELECT * FROM deltas", ctes=DELTAS_CTE)
def f35(spark, sf):
    return deltas(spark, sf)


@query("f36_employer_cost", """
SELECT period, kpi_id, value, previous, delta_pct FROM deltas WHERE kpi_id IN ('cout_employeur', 'cout_moyen')
""", ctes=DELTAS_CTE)
def f36(spark, sf):
    return deltas(spark, sf).filter("kpi_id IN ('cout_employeur', 'cout_moyen')").select(
        "period", "kpi_id", "value", "previous", "delta_pct")


@query("f37_active_headcount", "SELECT period, value AS effectifs, previous, delta_pct, trend FROM deltas WHERE kpi_id = 'effectifs'",
       ctes=DELTAS_CTE)
def f37(spark, sf):
    return deltas(spark, sf).filter("kpi_id = 'effectifs'").selectExpr(
        "period", "value AS effectifs", "previous", "delta_pct", "trend")


@query("f39_overtime_kpi", """
SELECT period, value AS heures_sup, previous, delta_pct, trend, alert_level FROM deltas WHERE kpi_id = 'heures_sup'
""", ctes=DELTAS_CTE)
def f39(spark, sf):
    return deltas(spark, sf).filter("kpi_id = 'heures_sup'").selectExpr(
        "period", "value AS heures_sup", "previous", "delta_pct", "trend", "alert_level")


@query("f38_turnover_rate", """
SELECT period, nouveaux, departs, (n_current + n_previous) / 2.0 AS effectif_moyen,
  round(CASE WHEN (n_current + n_previous) / 2.0 > 0 THEN departs / ((n_current + n_previous) / 2.0) * 100 ELSE 0.0 END, 6) AS taux,
  CASE WHEN CASE WHEN (n_current + n_previous) / 2.0 > 0 THEN departs / ((n_current + n_previous) / 2.0) * 100 ELSE 0.0 END > 15 THEN 'critical'
       WHEN CASE WHEN (n_current + n_previous) / 2.0 > 0 THEN departs / ((n_current + n_previous) / 2.0) * 100 ELSE 0.0 END > 10 THEN 'warning'
       ELSE 'ok' END AS alert_level
FROM (
  SELECT coalesce(c.period, p.period) AS period, count(c.emp) AS n_current, count(p.emp) AS n_previous,
    count(*) FILTER (WHERE c.emp IS NOT NULL AND p.emp IS NULL) AS nouveaux,
    count(*) FILTER (WHERE c.emp IS NULL AND p.emp IS NOT NULL) AS departs
  FROM (SELECT DISTINCT matricule AS emp, strftime(date_paie, '%Y-%m') AS period FROM canon) c
  FULL OUTER JOIN (SELECT DISTINCT matricule AS emp,
                     strftime(CAST(strftime(date_paie, '%Y-%m') || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS period
                   FROM canon) p ON c.emp = p.emp AND c.period = p.period
  WHERE coalesce(c.period, p.period) IN (SELECT DISTINCT strftime(date_paie, '%Y-%m') FROM canon)
  GROUP BY 1) a
WHERE n_previous > 0
""", ctes=CANON_CTE)
def f38(spark, sf):
    return R.turnover_rate(canon_lines(spark, sf), fx.employees(spark, sf))


@query("f40_kpi_history", """
SELECT d.period, d.kpi_id, d.value FROM deltas d
JOIN (SELECT period FROM (SELECT DISTINCT period FROM deltas) x ORDER BY period DESC LIMIT 12) l ON l.period = d.period
""", ctes=DELTAS_CTE)
def f40(spark, sf):
    return R.kpi_history(deltas(spark, sf), 12)


@query("f40_kpi_alerts", "SELECT * FROM deltas WHERE alert_level IN ('warning', 'critical')", ctes=DELTAS_CTE)
def f40a(spark, sf):
    return R.kpi_alerts(deltas(spark, sf))


@query("f41_summary", """
SELECT rows, employees, CAST(_n AS DOUBLE)/100.0 AS net_total, neg_pct FROM
  (SELECT count(*) AS rows, count(DISTINCT matricule) AS employees,
     CAST(sum(CASE WHEN montant_combine <> 0 THEN montant_employe ELSE 0 END) AS BIGINT) AS _n FROM canon) t,
  (SELECT round(avg(CASE WHEN _net < -1.0 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS neg_pct
   FROM (SELECT matricule, sum(montant_employe) AS _net FROM canon GROUP BY matricule) e) n
""", ctes=CANON_CTE)
def f41(spark, sf):
    return R.summary(canon_lines(spark, sf), fx.employees(spark, sf))


NEG_SQL = """SELECT date_paie, matricule, CAST(_net AS DOUBLE)/100.0 AS net FROM (
  SELECT date_paie, matricule, CAST(sum(montant_employe) AS BIGINT) AS _net FROM canon GROUP BY 1, 2) x WHERE _net < -1"""
UPPER_SQL = "nom_employe = upper(nom_employe) AND regexp_matches(nom_employe, '[A-Za-z]')"
SENS_SQL = "trim(code_paie) IN ('401', '501', '701', '999')"


@query("f42_audit_findings", f"""
SELECT date_paie, 'nets_negatifs' AS rule, count(*) AS n FROM ({NEG_SQL}) a GROUP BY 1
UNION ALL SELECT date_paie, 'noms_majuscules', count(DISTINCT nom_employe) FROM canon WHERE {UPPER_SQL} GROUP BY 1
UNION ALL SELECT date_paie, 'codes_sensibles', count(DISTINCT code_paie) FROM canon WHERE {SENS_SQL} GROUP BY 1
""", ctes=CANON_CTE)
def f42(spark, sf):
    return R.audit_findings(canon_lines(spark, sf), fx.employees(spark, sf))


@query("f42_anomalies", f"""
SELECT date_paie, 'Net négatif' AS type, matricule AS employe, net, CAST(NULL AS VARCHAR) AS code FROM ({NEG_SQL}) a
UNION ALL SELECT DISTINCT date_paie, 'Nom en MAJUSCULES', nom_employe, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR)
  FROM canon WHERE {UPPER_SQL}
UNION ALL SELECT DISTINCT date_paie, 'Code sensible', CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), code_paie
  FROM canon WHERE {SENS_SQL}
""", ctes=CANON_CTE)
def f42a(spark, sf):
    return R.anomalies(canon_lines(spark, sf), fx.employees(spark, sf))


def _deltas_sql(dim):
    return f"""nx_{dim} AS (SELECT date_paie AS _pd, lead(date_paie) OVER (ORDER BY date_paie) AS date_paie
               FROM (SELECT DISTINCT date_paie FROM canon) d),
per_{dim} AS (SELECT date_paie, {dim}, CAST(sum(montant_employe) AS BIGINT) AS _c FROM canon GROUP BY 1, 2),
dl_{dim} AS (
  SELECT coalesce(c.date_paie, p.date_paie) AS date_paie, coalesce(c._pd, p._pd) AS date_precedente,
    coalesce(c.{dim}, p.{dim}) AS {dim}, CAST(coalesce(c._c, 0) - coalesce(p._p, 0) AS DOUBLE)/100.0 AS delta,
    c._c IS NULL AS absent_current, p._p IS NULL AS absent_previous
  FROM (SELECT per.*, n._pd FROM per_{dim} per JOIN nx_{dim} n ON n.date_paie = per.date_paie) c
  FULL OUTER JOIN (SELECT n.date_paie, n._pd, per.{dim}, per._c AS _p FROM per_{dim} per
                   JOIN nx_{dim} n ON n._pd = per.date_paie WHERE n.date_paie IS NOT NULL) p
  ON c.date_paie = p.date_paie AND c._pd = p._pd AND c.{dim} = p.{dim})"""


@query("f43_compare_periods_code", "SELECT * FROM dl_code_paie",
       ctes=CANON_CTE + ",\n" + _deltas_sql("code_paie"))
def f43(spark, sf):
    return R.period_deltas_by(canon_lines(spark, sf), "code_paie")


@query("f43_compare_periods_post", "SELECT * FROM dl_poste_budgetaire",
       ctes=CANON_CTE + ",\n" + _deltas_sql("poste_budgetaire"))
def f43p(spark, sf):
    return R.period_deltas_by(canon_lines(spark, sf), "poste_budgetaire")


@query("f43_top_movers", """
SELECT date_paie, code_paie, delta, ru <= 5 AS is_top_up, rd <= 5 AS is_top_down FROM (
  SELECT *, row_number() OVER (PARTITION BY date_paie ORDER BY delta DESC, code_paie) AS ru,
    row_number() OVER (PARTITION BY date_paie ORDER BY delta ASC, code_paie) AS rd FROM dl_code_paie) x
WHERE ru <= 5 OR rd <= 5
""", ctes=CANON_CTE + ",\n" + _deltas_sql("code_paie"))
def f43t(spark, sf):
    return R.top_movers(R.period_deltas_by(canon_lines(spark, sf), "code_paie"), "code_paie", 5)


@query("f44_period_stats", """
SELECT t.date_paie, CAST(_n AS DOUBLE)/100.0 AS net_total, CAST(_n - _d AS DOUBLE)/100.0 AS brut_total,
  CAST(_d AS DOUBLE)/100.0 AS deductions_total, nb_employes, round(net_moyen, 6) AS net_moyen, round(net_median, 6) AS net_median
FROM (SELECT date_paie, CAST(sum(montant_employe) AS BIGINT) AS _n,
        CAST(sum(CASE WHEN montant_employe < 0 THEN montant_employe ELSE 0 END) AS BIGINT) AS _d
      FROM canon WHERE montant_combine <> 0 GROUP BY 1) t
JOIN (SELECT date_paie, count(*) AS nb_employes, avg(_net) / 100.0 AS net_moyen,
        quantile_cont(_net, 0.5) / 100.0 AS net_median
      FROM (SELECT date_paie, matricule, sum(montant_employe) AS _net FROM canon WHERE montant_combine <> 0 GROUP BY 1, 2) e
      GROUP BY 1) s ON s.date_paie = t.date_paie
""", ctes=CANON_CTE)
def f44(spark, sf):
    return R.period_stats(canon_lines(spark, sf), fx.employees(spark, sf))


ANOM_CTE = CANON_CTE + f""",
lp AS (SELECT *, strftime(date_paie, '%Y-%m') AS period FROM canon WHERE montant_combine <> 0),
a_neg AS (SELECT period, count(*) AS nets_negatifs FROM (SELECT period, matricule, sum(montant_employe) AS n FROM lp GROUP BY 1, 2) x
          WHERE n < -1 GROUP BY 1),
a_in AS (SELECT period, count(DISTINCT nom_employe) AS inactifs_avec_gains FROM lp
         WHERE {UPPER_SQL} AND lower(categorie_paie) = 'gains' AND montant_employe > 0 GROUP BY 1),
a_sens AS (SELECT period, count(DISTINCT code_paie) AS codes_sensibles FROM lp WHERE {SENS_SQL} GROUP BY 1),
a_new AS (SELECT period, count(*) AS nouveaux_codes FROM (
            SELECT c, min(period) AS period FROM (SELECT DISTINCT trim(code_paie) AS c, period FROM lp) d
            GROUP BY c HAVING count(*) = 1) s GROUP BY 1),
per AS (SELECT matricule, period, arg_min(poste_budgetaire, (date_paie, source_row_no)) AS _first,
          arg_max(poste_budgetaire, (date_paie, source_row_no)) AS _last, max((date_paie, source_row_no)) AS _lk
        FROM lp GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER w AS _rk, first_value(_last) OVER w AS _top, nth_value(_last, 2) OVER w AS _second
       FROM per WINDOW w AS (PARTITION BY matricule ORDER BY _lk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a_chg AS (SELECT period, count(*) AS changements_poste FROM (
            SELECT period, _first, CASE WHEN _rk = 1 THEN _second ELSE _top END AS other FROM rk) z
          WHERE other IS NOT NULL AND _first <> other GROUP BY 1)"""


@query("f45_anomaly_set", """
SELECT m.period, coalesce(nets_negatifs, 0) AS nets_negatifs, coalesce(inactifs_avec_gains, 0) AS inactifs_avec_gains,
  coalesce(codes_sensibles, 0) AS codes_sensibles, coalesce(nouveaux_codes, 0) AS nouveaux_codes,
  coalesce(changements_poste, 0) AS changements_poste
FROM (SELECT DISTINCT period FROM lp) m LEFT JOIN a_neg USING (period) LEFT JOIN a_in USING (period)
  LEFT JOIN a_sens USING (period) LEFT JOIN a_new USING (period) LEFT JOIN a_chg USING (period)
""", ctes=ANOM_CTE)
def f45(spark, sf):
    return R.anomaly_set(canon_lines(spark, sf), fx.employees(spark, sf))


@query("f46_period_tendency", """
SELECT date_paie, period_precedente, CAST(_n - _pn AS DOUBLE)/100.0 AS delta_net, CAST(_d - _pd AS DOUBLE)/100.0 AS delta_deductions,
  _e - _pe AS delta_effectif,
  CASE WHEN abs(CAST(_n - _pn AS DOUBLE)/100.0) < 100.0 THEN 'stable' WHEN CAST(_n - _pn AS DOUBLE)/100.0 > 0 THEN 'hausse' ELSE 'baisse' END AS tendance,
  CASE WHEN _pn <> 0 THEN round((_n - _pn) / abs(_pn) * 100.0, 6) ELSE 0.0 END AS pct_variation
FROM (SELECT *, lag(date_paie) OVER w AS period_precedente, lag(_n) OVER w AS _pn, lag(_d) OVER w AS _pd, lag(_e) OVER w AS _pe
      FROM (SELECT date_paie, CAST(sum(montant_employe) AS BIGINT) AS _n,
              CAST(sum(CASE WHEN montant_employe < 0 THEN montant_employe ELSE 0 END) AS BIGINT) AS _d,
              count(DISTINCT matricule) AS _e FROM canon WHERE montant_combine <> 0 GROUP BY 1) p
      WINDOW w AS (ORDER BY date_paie)) x
WHERE period_precedente IS NOT NULL
""", ctes=CANON_CTE)
def f46(spark, sf):
    return R.period_tendency(canon_lines(spark, sf), fx.employees(spark, sf))


@query("f47_report_summary", """
SELECT date_paie, indicateur, valeur FROM (
  SELECT date_paie, CAST(_n AS DOUBLE)/100.0 AS a, CAST(_n - _d AS DOUBLE)/100.0 AS b, CAST(_d AS DOUBLE)/100.0 AS c,
    CAST(_e AS DOUBLE) AS d, (CAST(_n AS DOUBLE)/100.0) / nullif(_e, 0) AS e
  FROM (SELECT date_paie, CAST(sum(montant_employe) AS BIGINT) AS _n,
          CAST(sum(CASE WHEN montant_employe < 0 THEN montant_employe ELSE 0 END) AS BIGINT) AS _d,
          count(DISTINCT matricule) AS _e FROM canon GROUP BY 1) x) y
UNPIVOT INCLUDE NULLS (valeur FOR indicateur IN (a AS 'Net total', b AS 'Brut total', c AS 'Déductions', d AS 'Nb employés',
  e AS 'Net moyen'))
""", ctes=CANON_CTE)
def f47(spark, sf):
    return R.report_summary(canon_lines(spark, sf), fx.employees(spark, sf))


def _cat_sum(c):
    return f"CAST(coalesce(sum(CASE WHEN categorie_paie = '{c}' THEN montant_employe END), 0) AS BIGINT)"


@query("f48_report_employee_pivot", f"""
SELECT date_paie, matricule, nom_employe, CAST(g AS DOUBLE)/100.0 AS "Gains", CAST(-abs(d) AS DOUBLE)/100.0 AS "Deductions",
  CAST(dl AS DOUBLE)/100.0 AS "Deductions_legales", CAST(-abs(a) AS DOUBLE)/100.0 AS "Assurances",
  CAST(s AS DOUBLE)/100.0 AS "Syndicats", CAST(g - abs(d) AS DOUBLE)/100.0 AS "Net"
FROM (SELECT date_paie, matricule, nom_employe, {_cat_sum('Gains')} AS g, {_cat_sum('Deductions')} AS d,
        {_cat_sum('Deductions_legales')} AS dl, {_cat_sum('Assurances')} AS a, {_cat_sum('Syndicats')} AS s
      FROM canon GROUP BY 1, 2, 3) x
""", ctes=CANON_CTE)
def f48(spark, sf):
    return R.report_employee_pivot(canon_lines(spark, sf), fx.employees(spark, sf))


SPELLED_CTE = """spelled AS (
  SELECT date_paie, matricule, nom_employe, montant_employe, CASE WHEN categorie_paie = 'Deductions' AND source_row_no % 3 = 0 THEN 'Déductions'
    WHEN categorie_paie = 'Deductions' AND source_row_no % 3 = 1 THEN 'DÉDUCTIONS' WHEN source_row_no % 41 = 0 THEN 'N/A' ELSE categorie_paie END AS categorie
  FROM canon),
signed AS (
  SELECT date_paie, matricule, nom_employe, categorie,
    CASE WHEN categorie IN ('Deductions', 'Déductions', 'DÉDUCTIONS', 'Assurances') THEN -abs(c) ELSE c END AS c
  FROM (SELECT date_paie, matricule, nom_employe, categorie, CAST(sum(montant_employe) AS BIGINT) AS c FROM spelled GROUP BY ALL) x)"""


def _spelled(spark, sf):
    """Canonical lines whose deductions are spelled in three ways, some without category."""
    c, r = F.col("categorie_paie"), F.col("source_row_no")
    return canon_lines(spark, sf).withColumn("categorie_paie", F.when((c == "Deductions") & (r % 3 == 0), "Déductions")
                                             .when((c == "Deductions") & (r % 3 == 1), "DÉDUCTIONS").when(r % 41 == 0, F.lit(None)).otherwise(c))


@query("f48_report_employee_rows", """
SELECT date_paie, matricule, nom_employe, categorie, CAST(c AS DOUBLE)/100.0 AS montant,
  CAST(sum(CASE WHEN categorie IN ('Gains', 'Deductions', 'Déductions', 'DÉDUCTIONS') THEN c ELSE 0 END)
    OVER (PARTITION BY date_paie, matricule, nom_employe) AS DOUBLE)/100.0 AS "Net"
FROM signed
""", ctes=CANON_CTE + ",\n" + SPELLED_CTE)
def f48r(spark, sf):
    return R.report_employee_rows(_spelled(spark, sf), fx.employees(spark, sf))


def _spelled_col(c):
    return f"coalesce(CAST(sum(CASE WHEN lower(categorie) = '{c.lower()}' THEN c END) AS DOUBLE)/100.0, 0.0) AS \"{c}\""


@query("f48_report_accented_pivot", f"""
SELECT date_paie, matricule, nom_employe, {", ".join(map(_spelled_col, ["Gains", "Deductions", "Deductions_legales", "Assurances", "Syndicats", "N/A", "DÉDUCTIONS"]))},
  CAST(sum(CASE WHEN categorie IN ('Gains', 'Deductions', 'Déductions', 'DÉDUCTIONS') THEN c ELSE 0 END) AS DOUBLE)/100.0 AS "Net"
FROM signed GROUP BY date_paie, matricule, nom_employe
""", ctes=CANON_CTE + ",\n" + SPELLED_CTE)
def f48a(spark, sf):
    return R.report_employee_pivot(_spelled(spark, sf), fx.employees(spark, sf))


@query("f49_report_by_code", """
SELECT date_paie, code_paie, description_code_paie, CAST(sum(montant_employe) AS DOUBLE)/100.0 AS montant FROM canon GROUP BY 1, 2, 3
""", ctes=CANON_CTE)
def f49(spark, sf):
    return R.report_by_code(canon_lines(spark, sf))


@query("f49_report_by_post", """
SELECT date_paie, poste_budgetaire, CAST(sum(montant_employe) AS DOUBLE)/100.0 AS montant FROM canon GROUP BY 1, 2
""", ctes=CANON_CTE)
def f49p(spark, sf):
    return R.report_by_post(canon_lines(spark, sf))


@query("f50_evolution", """
SELECT period, CAST(_n AS DOUBLE)/100.0 AS net_total FROM (
  SELECT strftime(date_paie, '%Y-%m') AS period, CAST(sum(montant_employe) AS BIGINT) AS _n FROM canon GROUP BY 1) x
ORDER BY period DESC LIMIT 12
""", ctes=CANON_CTE)
def f50(spark, sf):
    return R.evolution(canon_lines(spark, sf), 12)


@query("f51_dashboard_series", """
SELECT pay_date, CAST(_m AS DOUBLE)/100.0 AS masse, CAST(_n AS DOUBLE)/100.0 AS net, transactions FROM (
  SELECT pay_date, CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS BIGINT) AS _m,
    CAST(sum(amount_cents) AS BIGINT) AS _n, count(*) AS transactions
  FROM ledger WHERE pay_date <= (SELECT max(pay_date) FROM ledger) GROUP BY pay_date) x
ORDER BY pay_date DESC LIMIT 30
""")
def f51(spark, sf):
    return R.dashboard_series(fx.ledger(spark, sf))


def _top_sql(dims, n=10):
    d = ", ".join(dims)
    return f"""SELECT {d}, CAST(_t AS DOUBLE)/100.0 AS total FROM (
  SELECT {d}, CAST(sum(montant_employe) AS BIGINT) AS _t FROM canon
  WHERE date_paie = (SELECT max(date_paie) FROM canon) GROUP BY {d}) x
ORDER BY abs(_t) DESC, {d} LIMIT {n}"""


@query("f52_top_codes", _top_sql(["code_paie", "description_code_paie"]), ctes=CANON_CTE)
def f52c(spark, sf):
    return R.top_by_abs(canon_lines(spark, sf), ["code_paie", "description_code_paie"])


@query("f52_top_posts", _top_sql(["poste_budgetaire"]), ctes=CANON_CTE)
def f52p(spark, sf):
    return R.top_by_abs(canon_lines(spark, sf), ["poste_budgetaire"])


@query("f52_top_employees", _top_sql(["matricule", "nom_employe"]), ctes=CANON_CTE)
def f52e(spark, sf):
    return R.top_by_abs(canon(spark, sf), ["matricule", "nom_employe"])


@query("f53_distribution", """
SELECT categorie_paie, CAST(_t AS DOUBLE)/100.0 AS total FROM (
  SELECT categorie_paie, CAST(sum(montant_employe) AS BIGINT) AS _t FROM canon GROUP BY 1) x
ORDER BY _t DESC, categorie_paie LIMIT 8
""", ctes=CANON_CTE)
def f53(spark, sf):
    return R.distribution(canon_lines(spark, sf), "categorie_paie", 8)


@query("f53_distribution_description", """
SELECT description_code_paie, CAST(_t AS DOUBLE)/100.0 AS total FROM (
  SELECT description_code_paie, CAST(sum(montant_employe) AS BIGINT) AS _t FROM canon GROUP BY 1) x
ORDER BY _t DESC, description_code_paie NULLS FIRST LIMIT 10
""", ctes=CANON_CTE)
def f53d(spark, sf):
    return R.distribution(canon_lines(spark, sf), "description_code_paie", 10)


RET = "regexp_matches(lower(description_code_paie), 'retraite|rrq|reer|pension|401k|retirement')"
INV = "regexp_matches(lower(description_code_paie), 'invest|épargne|epargne|reer|celi|tfsa|placement')"


@query("f54_keyword_totals", f"""
SELECT theme, coalesce(total, 0.0) AS total, round(coalesce(average, 0.0), 6) AS average, n_lines FROM (
  SELECT 'retraite' AS theme, abs(CAST(sum(montant_employe) AS DOUBLE)/100.0) AS total,
    abs(avg(montant_employe) / 100.0) AS average, count(*) AS n_lines FROM canon WHERE {RET}
  UNION ALL
  SELECT 'investissement', abs(CAST(sum(montant_employe) AS DOUBLE)/100.0), abs(avg(montant_employe) / 100.0), count(*)
  FROM canon WHERE {INV}) x
""", ctes=CANON_CTE)
def f54(spark, sf):
    return R.keyword_totals(canon_lines(spark, sf))


@query("f54_retirement_top_employees", f"""
SELECT matricule, CAST(_a AS DOUBLE)/100.0 AS amount FROM (
  SELECT matricule, CAST(abs(sum(montant_employe)) AS BIGINT) AS _a FROM canon WHERE {RET} GROUP BY 1) x
ORDER BY _a DESC, matricule LIMIT 10
""", ctes=CANON_CTE)
def f54e(spark, sf):
    return R.retirement_top_employees(canon(spark, sf))


@query("f55_budget_vs_actual", """
SELECT poste_budgetaire, CAST(_s AS DOUBLE)/100.0 AS spent, CAST(_a AS DOUBLE)/100.0 AS allocated,
  CAST(_a - _s AS DOUBLE)/100.0 AS variance
FROM (SELECT poste_budgetaire, _s, CAST(round(_s * 110 / 100) AS BIGINT) AS _a FROM (
  SELECT poste_budgetaire, CAST(abs(sum(montant_employe)) AS BIGINT) AS _s FROM canon GROUP BY 1) x) y
""", ctes=CANON_CTE)
def f55(spark, sf):
    return R.budget_vs_actual(canon_lines(spark, sf))


@query("f56_equity", """
SELECT titre_emploi, round(quantile_cont(_net, 0.5), 6) AS median,
  round(quantile_cont(_net, 0.75) - quantile_cont(_net, 0.25), 6) AS iqr, count(*) AS n
FROM (SELECT titre_emploi, matricule, sum(montant_employe) / 100.0 AS _net FROM canon GROUP BY 1, 2) x GROUP BY 1
""", ctes=CANON_CTE)
def f56(spark, sf):
    return R.equity(canon_lines(spark, sf), emp=fx.employees(spark, sf))


@query("f57_pay_frequency", """
SELECT round(avg(gap), 6) AS mean_gap, min(gap) AS min_gap, max(gap) AS max_gap, count(*) AS n_gaps,
  CASE WHEN round(avg(gap), 6) BETWEEN 6 AND 8 THEN 'hebdomadaire' WHEN round(avg(gap), 6) BETWEEN 13 AND 15 THEN 'bi-hebdomadaire'
       WHEN round(avg(gap), 6) BETWEEN 14 AND 16 THEN 'bi-mensuelle' WHEN round(avg(gap), 6) BETWEEN 28 AND 32 THEN 'mensuelle'
       ELSE 'irreguliere' END AS frequence
FROM (SELECT CAST(date_diff('day', lag(pay_date) OVER (ORDER BY pay_date), pay_date) AS INT) AS gap
      FROM (SELECT DISTINCT pay_date FROM ledger) d) g WHERE gap IS NOT NULL
""")
def f57(spark, sf):
    return R.pay_frequency(fx.ledger(spark, sf))


@query("f57_sequence_range", """
SELECT CAST(year(pay_date) AS INT) AS annee, min(period_seq_in_year) AS seq_min, max(period_seq_in_year) AS seq_max,
  count(*) AS n_periods FROM periods GROUP BY 1
""")
def f57s(spark, sf):
    return R.sequence_range(fx.periods(spark, sf))


@query("f58_imported_files", """
SELECT source_file, min(pay_date) AS date_min, count(*) AS lignes, count(DISTINCT employee_id) AS employes
FROM ledger GROUP BY source_file
""")
def f58(spark, sf):
    return R.imported_files(fx.ledger(spark, sf))


@query("f59_period_list", """
SELECT coalesce(p.pay_date, t.pay_date, i.pay_date) AS pay_date,
  CASE WHEN p.status IS NOT NULL THEN 'periode' WHEN t.n_ledger IS NOT NULL THEN 'ledger' ELSE 'import' END AS origine,
  p.status, coalesce(t.n_ledger, 0) AS n_ledger, coalesce(i.n_import, 0) AS n_import
FROM periods p
FULL OUTER JOIN (SELECT pay_date, count(*) AS n_ledger FROM ledger GROUP BY 1) t ON t.pay_date = p.pay_date
FULL OUTER JOIN (SELECT pay_date, count(*) AS n_import FROM stg_lines WHERE pay_date IS NOT NULL GROUP BY 1) i
  ON i.pay_date = coalesce(p.pay_date, t.pay_date)
""")
def f59(spark, sf):
    return R.period_list(fx.periods(spark, sf), fx.ledger(spark, sf), fx.stg_lines(spark, sf))


@query("f60_ledger_stats", """
SELECT * FROM (SELECT count(*) AS n_lines, CAST(sum(amount_cents) AS DOUBLE)/100.0 AS total,
                 count(DISTINCT source_file) AS n_files, count(DISTINCT employee_id) AS n_employees FROM ledger) a,
  (SELECT count(*) FILTER (WHERE status = 'ouverte') AS open_periods FROM periods) p,
  (SELECT count(*) FILTER (WHERE statut = 'actif') AS active_employees FROM employees) e
""")
def f60(spark, sf):
    return R.ledger_stats(fx.ledger(spark, sf), fx.periods(spark, sf), fx.employees(spark, sf))


@query("f61_rollup_series", """
SELECT CASE WHEN day IS NOT NULL THEN 'day' WHEN month IS NOT NULL THEN 'month' ELSE 'year' END AS grain,
  coalesce(day, month, year) AS bucket, categorie_paie, CAST(CAST(sum(montant_employe) AS BIGINT) AS DOUBLE)/100.0 AS total,
  count(*) AS n
FROM (SELECT CAST(date_paie AS VARCHAR) AS day, strftime(date_paie, '%Y-%m') AS month, strftime(date_paie, '%Y') AS year,
        categorie_paie, montant_employe FROM canon) x
GROUP BY GROUPING SETS ((day, categorie_paie), (month, categorie_paie), (year, categorie_paie))
""", ctes=CANON_CTE)
def f61(spark, sf):
    return R.rollup_series(canon_lines(spark, sf), "categorie_paie")


@query("f62_batch_summary", """
SELECT * FROM (SELECT max(pay_date) AS pay_date, count(*) AS n_lines, CAST(sum(amount_cents) AS DOUBLE)/100.0 AS total,
                 count(DISTINCT employee_id) AS n_employees
               FROM ledger WHERE pay_date = (SELECT max(pay_date) FROM batches WHERE status = 'completed')) a,
  (SELECT count(*) AS n_rejected FROM stg_lines WHERE pay_date = (SELECT max(pay_date) FROM batches WHERE status = 'completed')
     AND (amount_cents = 0 OR employer_cents < 0)) r
""")
def f62(spark, sf):
    return R.batch_summary(fx.ledger(spark, sf), fx.batches(spark, sf), fx.stg_lines(spark, sf))


@query("f63_period_report", """
SELECT date_paie, matricule, nom_employe, code_paie, description_code_paie, CAST(montant_employe AS DOUBLE)/100.0 AS montant,
  CAST(part_employeur AS DOUBLE)/100.0 AS part_employeur, source_file, source_row_no
FROM canon WHERE date_paie = (SELECT max(date_paie) FROM canon)
""", ctes=CANON_CTE)
def f63(spark, sf):
    return R.period_report(canon(spark, sf))


@query("f64_employees_for_date", """
SELECT t.pay_date, t.employee_id, e.nom_complet, coalesce(nullif(trim(e.categorie_emploi), ''), 'Non défini') AS categorie_emploi,
  e.titre_emploi, CAST(t._n AS DOUBLE)/100.0 AS net,
  CASE WHEN (e.nom_complet = upper(e.nom_complet) AND regexp_matches(e.nom_complet, '[A-Za-z]')) OR e.statut = 'inactif' THEN 'inactif'
       WHEN t._any THEN 'actif' ELSE 'sans_paie' END AS statut_calcule
FROM (SELECT pay_date, employee_id, CAST(sum(amount_cents) AS BIGINT) AS _n, bool_or(amount_cents <> 0) AS _any
      FROM ledger GROUP BY 1, 2) t LEFT JOIN employees e ON e.employee_id = t.employee_id
""")
def f64(spark, sf):
    return R.employees_for_date(fx.ledger(spark, sf), fx.employees(spark, sf))


@query("f62_file_summary", """
SELECT source_file, count(*) AS n_lines,
  count(*) FILTER (WHERE pay_date IS NULL OR amount_cents = 0 OR employer_cents < 0 OR trim(pay_code) = '') AS n_rejected,
  CAST(sum(amount_cents) AS DOUBLE)/100.0 AS total, count(DISTINCT employee_id) AS n_employees,
  min(pay_date) AS date_min, max(pay_date) AS date_max
FROM stg_lines GROUP BY source_file
""")
def f62f(spark, sf):
    return R.file_summary(fx.stg_lines(spark, sf))


@query("f47_report_summary_formatted", """
SELECT date_paie, indicateur,
  CASE WHEN indicateur = 'Nb employés' THEN replace(format('{:,}', CAST(valeur AS BIGINT)), ',', '\u202f')
       ELSE (CASE WHEN valeur < 0 THEN '-' ELSE '' END) || replace(format('{:,.2f}', abs(valeur)), ',', ' ') || ' $'
  END AS valeur_affichee
FROM (SELECT date_paie, indicateur, valeur FROM (
  SELECT date_paie, CAST(_n AS DOUBLE)/100.0 AS a, CAST(_n - _d AS DOUBLE)/100.0 AS b, CAST(_d AS DOUBLE)/100.0 AS c,
    CAST(_e AS DOUBLE) AS d, (CAST(_n AS DOUBLE)/100.0) / nullif(_e, 0) AS e
  FROM (SELECT date_paie, CAST(sum(montant_employe) AS BIGINT) AS _n,
          CAST(sum(CASE WHEN montant_employe < 0 THEN montant_employe ELSE 0 END) AS BIGINT) AS _d,
          count(DISTINCT matricule) AS _e FROM canon GROUP BY 1) x) y
  UNPIVOT INCLUDE NULLS (valeur FOR indicateur IN (a AS 'Net total', b AS 'Brut total', c AS 'Déductions',
    d AS 'Nb employés', e AS 'Net moyen'))) z
""", ctes=CANON_CTE)
def f47f(spark, sf):
    from pyspark.sql import functions as F
    from paysift.functions.formatting import money_fr, number_fr
    s = R.report_summary(canon_lines(spark, sf), fx.employees(spark, sf))
    return s.select("date_paie", "indicateur",
                    F.when(F.col("indicateur") == "Nb employés", number_fr("valeur"))
                    .otherwise(money_fr("valeur")).alias("valeur_affichee"))


def _breakdown_sql(by):
    return f"""SELECT source_file, {by}, count(*) AS n_lines, CAST(sum(amount_cents) AS DOUBLE)/100.0 AS total,
  CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS gains,
  CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS deductions
FROM stg_lines GROUP BY source_file, {by}"""


@query("f62_file_by_code", _breakdown_sql("pay_code"))
def f62c(spark, sf):
    return R.file_breakdown(fx.stg_lines(spark, sf), "pay_code")


@query("f62_file_by_period", _breakdown_sql("pay_date"))
def f62p(spark, sf):
    return R.file_breakdown(fx.stg_lines(spark, sf), "pay_date")


@query("f62_file_top_employees", """
SELECT source_file, CAST(rang AS INT) AS rang, employee_id, CAST(n AS DOUBLE)/100.0 AS net FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, employee_id) AS rang FROM (
    SELECT source_file, employee_id, CAST(sum(amount_cents) AS BIGINT) AS n FROM stg_lines WHERE employee_id IS NOT NULL GROUP BY 1, 2) p) r
WHERE rang <= 10
""")
def f62t(spark, sf):
    return R.file_top_employees(fx.stg_lines(spark, sf))
