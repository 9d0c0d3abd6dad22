"""Validation (D1-D20) and warehouse (E1-E15) queries over the disturbed staging fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.operators import kpi
from paysift.operators import quality as Q
from paysift.operators import warehouse as W
from paysift.operators.lines import canonical_lines
from paysift.sources import fixtures as fx
from paysift.sources.sinks import stored, work_dir

from .catalog import query
from .profile_plans import PAYFILE_CTE, q
from .sqltext import STAR_INNER, amount_cents, parse_date

STAGED_CTE = """staged AS MATERIALIZED (
  SELECT *, len(validation_errors) = 0 AS is_valid FROM (
    SELECT s.*, list_filter([
        CASE WHEN pay_date IS NULL THEN 'DATE_PAIE_MANQUANTE' END,
        CASE WHEN employee_id IS NULL OR trim(CAST(employee_id AS VARCHAR)) = '' THEN 'MATRICULE_MANQUANT' END,
        CASE WHEN pay_code IS NULL OR trim(pay_code) = '' THEN 'CODE_PAIE_MANQUANT' END,
        CASE WHEN amount_cents IS NULL THEN 'MONTANT_MANQUANT' END,
        CASE WHEN coalesce(employer_cents, 0) < 0 THEN 'PART_EMPLOYEUR_NEGATIVE' END], lambda x: x IS NOT NULL)
        AS validation_errors,
      md5(concat_ws('|', coalesce(CAST(pay_date AS VARCHAR), ''), coalesce(CAST(employee_id AS VARCHAR), ''),
        coalesce(pay_code, ''), coalesce(coalesce(budget_post, 'N/A'), ''), coalesce(CAST(amount_cents AS VARCHAR), '0'),
        coalesce(CAST(employer_cents AS VARCHAR), '0'))) AS cle_metier
    FROM stg_lines s) x)"""

CODEDIM_CTE = """codedim AS (
  SELECT pay_code, label, categorie AS categorie_paie FROM codes
  UNION ALL
  SELECT pay_code, pay_code AS label, CASE WHEN avg(amount_cents) >= 0 THEN 'Gains' ELSE 'Deductions' END
  FROM staged WHERE is_valid AND pay_code IS NOT NULL AND pay_code <> ''
    AND pay_code NOT IN (SELECT pay_code FROM codes) GROUP BY pay_code)"""

LEDGER2_CTE = """known AS MATERIALIZED (
  SELECT s.* FROM staged s SEMI JOIN employees e ON e.employee_id = s.employee_id
  WHERE s.is_valid AND s.amount_cents <> 0 AND s.pay_date IS NOT NULL),
seq AS MATERIALIZED (
  SELECT pay_date, CAST(dense_rank() OVER (PARTITION BY year(pay_date) ORDER BY pay_date) AS INT) AS period_seq_in_year
  FROM (SELECT DISTINCT pay_date FROM known) d),
ledger2 AS MATERIALIZED (
  SELECT s.*, p.period_seq_in_year, CAST(year(s.pay_date) AS INT) AS pay_year
  FROM known s JOIN seq p ON p.pay_date = s.pay_date)"""


def staged(spark, sf):
    return W.stage(fx.stg_lines(spark, sf))


def code_dim(spark, sf, st=None):
    st = staged(spark, sf) if st is None else st
    base = W.dim_code(fx.codes(spark))
    return base.unionByName(W.infer_codes(st.filter("is_valid"), base))


#: What the import path (E11, E12, D19) reads of a staged line.
IMPORT_COLUMNS = ["batch_id", "source_file", "source_row_no", "pay_date", "employee_id", "amount_cents", "is_valid"]


def built_ledger(spark, sf, st=None):
    return W.build_ledger((staged(spark, sf) if st is None else st).filter("is_valid"), fx.employees(spark, sf))


# ------------------------------------------------------------------------------ D

@query("d01_validate_lines", """
SELECT batch_id, source_row_no, is_valid, array_to_string(validation_errors, ',') AS validation_errors FROM staged
""", ctes=STAGED_CTE)
def d01(spark, sf):
    return staged(spark, sf).select("batch_id", "source_row_no", "is_valid",
                                    F.array_join("validation_errors", ",").alias("validation_errors"))


@query("d02_issue_stats", "SELECT issue, COUNT(*) AS n_lines FROM (SELECT unnest(validation_errors) AS issue FROM staged) u GROUP BY issue",
       ctes=STAGED_CTE)
def d02(spark, sf):
    return Q.issue_stats(staged(spark, sf))


@query("d02_stage_summary", """
SELECT COUNT(*) AS total, count(*) FILTER (WHERE is_valid) AS clean, count(*) FILTER (WHERE NOT is_valid) AS with_issues
FROM staged""", ctes=STAGED_CTE)
def d02s(spark, sf):
    return Q.stage_summary(staged(spark, sf))


@query("d03_commit_split", "SELECT batch_id, source_row_no, cle_metier FROM staged WHERE is_valid", ctes=STAGED_CTE)
def d03(spark, sf):
    clean, _ = Q.commit_split(staged(spark, sf))
    return clean.select("batch_id", "source_row_no", "cle_metier")


@query("d04_alert_log", "SELECT batch_id, source_row_no, unnest(validation_errors) AS alert_type FROM staged",
       ctes=STAGED_CTE)
def d04(spark, sf):
    return Q.alert_log(staged(spark, sf))


@query("d05_quality_suite", """
SELECT test, n, CASE WHEN n = 0 THEN 'OK' ELSE 'WARNING' END AS status FROM (
  SELECT 'net_identity' AS test, (SELECT count(*) FROM (
      SELECT strftime(pay_date, '%Y-%m') AS m, sum(amount_cents) AS c FROM stg_lines WHERE pay_date IS NOT NULL
        AND categorie_paie IN ('Gains', 'Deductions', 'Deductions_legales', 'Assurances', 'Syndicats') GROUP BY 1) f
    FULL OUTER JOIN (SELECT strftime(pay_date, '%Y-%m') AS m, sum(amount_cents) AS net FROM ledger GROUP BY 1) k USING (m)
    WHERE f.c IS NULL OR k.net IS NULL OR abs(f.c - k.net) > 1) AS n
  UNION ALL SELECT 'negative_gains', count(*) FILTER (WHERE categorie_paie = 'Gains' AND amount_cents < 0) FROM stg_lines
  UNION ALL SELECT 'positive_deductions', count(*) FILTER (WHERE categorie_paie IN ('Deductions', 'Deductions_legales', 'Assurances', 'Syndicats')
    AND amount_cents > 0) FROM stg_lines
  UNION ALL SELECT 'negative_employer_share', count(*) FILTER (WHERE employer_cents < 0) FROM stg_lines) t
""")
def d05(spark, sf):
    """Disturbed lines against the monthly KPI of the clean ledger: every test finds something."""
    return Q.quality_suite(fx.stg_lines(spark, sf), kpi.kpi_star_month(fx.ledger(spark, sf)))


@query("d06_kpi_identity_tests", f"""
SELECT date_paie,
  CAST(abs(_net - (_gains - _adj + _ded_net)) AS DOUBLE)/100.0 AS ecart_net,
  round(abs(CAST(_net - (_gains - _adj + _ded_net) AS DOUBLE) / nullif(_gains, 0)), 6) AS ecart_net_pct,
  CAST(abs((_net + _er) - (_gains - _adj + _er)) AS DOUBLE)/100.0 AS ecart_cash_out,
  round(abs(CAST((_net + _er) - (_gains - _adj + _er) AS DOUBLE) / nullif(_gains + _er, 0)), 6) AS ecart_cash_out_pct,
  CAST(abs(_ded_net - (-_ded_brut + _refund)) AS DOUBLE)/100.0 AS ecart_deductions,
  CASE WHEN abs(CAST(_net - (_gains - _adj + _ded_net) AS DOUBLE) / nullif(_gains, 0)) > 0.0001 THEN 'FAIL' ELSE 'PASS' END
    AS test_net_status,
  CASE WHEN abs(CAST((_net + _er) - (_gains - _adj + _er) AS DOUBLE) / nullif(_gains + _er, 0)) > 0.0001 THEN 'FAIL'
    ELSE 'PASS' END AS test_cash_out_status
FROM (SELECT pay_date AS date_paie, {STAR_INNER} FROM ledger GROUP BY pay_date) t
""")
def d06(spark, sf):
    return Q.kpi_identity_tests(kpi.kpi_star(fx.ledger(spark, sf)))


@query("d07_reconcile", """
SELECT coalesce(a.pay_date, b.pay_date) AS pay_date, a.c AS detail, b.c AS summary,
  coalesce(a.c, 0) - coalesce(b.c, 0) AS gap, (abs(coalesce(a.c, 0) - coalesce(b.c, 0)) <= 0 AND a.c IS NOT NULL AND b.c IS NOT NULL) AS ok
FROM (SELECT pay_date, CAST(sum(amount_cents) AS BIGINT) AS c FROM ledger GROUP BY pay_date) a
FULL OUTER JOIN (SELECT pay_date, CAST(sum(amount_cents) AS BIGINT) AS c FROM stg_lines GROUP BY pay_date) b
  ON a.pay_date IS NOT DISTINCT FROM b.pay_date
""")
def d07(spark, sf):
    a = fx.ledger(spark, sf).groupBy("pay_date").agg(F.sum("amount_cents").cast("long").alias("c"))
    b = fx.stg_lines(spark, sf).groupBy("pay_date").agg(F.sum("amount_cents").cast("long").alias("c"))
    return Q.reconcile(a, b, "pay_date", "c", "c")


@query("d08_compare_amounts", """
SELECT coalesce(o.pay_date, n.pay_date) AS pay_date, old_cents, new_cents,
  coalesce(new_cents, 0) - coalesce(old_cents, 0) AS gap_cents,
  CASE WHEN old_cents <> 0 THEN round(CAST(coalesce(new_cents, 0) - coalesce(old_cents, 0) AS DOUBLE) * 100.0 / old_cents, 6) END AS gap_pct
FROM (SELECT pay_date, CAST(sum(amount_cents) AS BIGINT) AS old_cents FROM stg_lines GROUP BY pay_date) o
FULL OUTER JOIN (SELECT pay_date, CAST(sum(amount_cents) AS BIGINT) AS new_cents FROM ledger GROUP BY pay_date) n
  ON o.pay_date = n.pay_date
""")
def d08(spark, sf):
    return Q.compare_amounts(fx.stg_lines(spark, sf), fx.ledger(spark, sf))


@query("d08_compare_counts", """
SELECT old_n, new_n, new_n - old_n AS diff, round((new_n - old_n) * 100.0 / old_n, 6) AS diff_pct
FROM (SELECT count(DISTINCT employee_id) AS old_n FROM stg_lines) o,
     (SELECT count(DISTINCT employee_id) AS new_n FROM ledger) n
""")
def d08c(spark, sf):
    return Q.compare_counts(fx.stg_lines(spark, sf), fx.ledger(spark, sf))


@query("d09_ledger_checks", """
SELECT * FROM (
  SELECT 'src_rows' AS "check", CAST(count(*) AS BIGINT) AS value FROM stg_lines
  UNION ALL SELECT 'src_cents', CAST(sum(amount_cents) AS BIGINT) FROM stg_lines
  UNION ALL SELECT 'tx_rows', CAST(count(*) AS BIGINT) FROM ledger
  UNION ALL SELECT 'tx_cents', CAST(sum(amount_cents) AS BIGINT) FROM ledger
  UNION ALL SELECT 'tx_employees', CAST(count(DISTINCT employee_id) AS BIGINT) FROM ledger
  UNION ALL SELECT 'tx_employees_nonzero', CAST(count(DISTINCT CASE WHEN amount_cents <> 0 THEN employee_id END) AS BIGINT) FROM ledger
  UNION ALL SELECT 'tx_zero_amounts', CAST(count(*) FILTER (WHERE amount_cents = 0) AS BIGINT) FROM ledger
  UNION ALL SELECT 'tx_year_mismatch', CAST(count(*) FILTER (WHERE pay_year <> year(pay_date)) AS BIGINT) FROM ledger
  UNION ALL SELECT 'partition_' || CAST(pay_year AS VARCHAR), CAST(count(*) AS BIGINT) FROM ledger GROUP BY pay_year) t
""")
def d09(spark, sf):
    return Q.ledger_checks(fx.stg_lines(spark, sf), fx.ledger(spark, sf))


@query("d10_orphans", """
SELECT * FROM stg_lines s WHERE NOT EXISTS (SELECT 1 FROM employees e WHERE e.employee_id = s.employee_id)
""")
def d10(spark, sf):
    return Q.orphans(fx.stg_lines(spark, sf), fx.employees(spark, sf))


@query("d11_orphan_employees", """
SELECT * FROM employees e WHERE employee_id NOT IN (SELECT employee_id FROM ledger WHERE employee_id IS NOT NULL)
""")
def d11(spark, sf):
    return Q.orphan_employees(fx.employees(spark, sf), fx.ledger(spark, sf))


@query("d11_keep_employees", "SELECT * FROM employees e WHERE EXISTS (SELECT 1 FROM ledger t WHERE t.employee_id = e.employee_id)")
def d11k(spark, sf):
    return Q.drop_orphan_employees(fx.employees(spark, sf), fx.ledger(spark, sf))


@query("d12_duplicate_keys", "SELECT cle_metier, count(*) AS n FROM staged WHERE is_valid GROUP BY cle_metier HAVING count(*) > 1",
       ctes=STAGED_CTE)
def d12(spark, sf):
    return Q.duplicate_keys(staged(spark, sf).filter("is_valid"), ["cle_metier"])


def _canon_sql(src):
    return f"""SELECT t.pay_date AS date_paie, t.amount_cents + t.employer_cents AS montant_combine, e.nom_complet AS nom_employe
      FROM {src} t LEFT JOIN employees e ON e.employee_id = t.employee_id"""


@query("d13_view_checks", f"""
SELECT view, count(*) AS n_rows, count(*) FILTER (WHERE date_paie IS NULL) AS null_dates,
  count(*) FILTER (WHERE montant_combine IS NULL) AS null_amounts,
  count(*) FILTER (WHERE nom_employe IS NULL OR trim(nom_employe) = '') AS no_name
FROM (SELECT 'lignes' AS view, * FROM ({_canon_sql('ledger')}) a
      UNION ALL SELECT 'staging', * FROM ({_canon_sql('stg_lines')}) b) u
GROUP BY view
""")
def d13(spark, sf):
    cd, emp = fx.codes(spark), fx.employees(spark, sf)
    return Q.view_checks({"lignes": canonical_lines(fx.ledger(spark, sf), cd, emp),
                          "staging": canonical_lines(fx.stg_lines(spark, sf), cd, emp)})


HIST_CTE = """hist AS (
  SELECT employee_id, budget_post, min(pay_date) AS date_debut, max(pay_date) AS date_fin
  FROM ledger GROUP BY employee_id, budget_post)"""


def hist(spark, sf):
    return fx.ledger(spark, sf).groupBy("employee_id", "budget_post").agg(
        F.min("pay_date").alias("date_debut"), F.max("pay_date").alias("date_fin"))


@query("d14_overlaps", """
SELECT employee_id, budget_post, date_debut, date_fin FROM (
  SELECT *, max(date_fin) OVER (PARTITION BY employee_id ORDER BY date_debut, date_fin, budget_post
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM hist) x
WHERE prev_end IS NOT NULL AND date_debut <= prev_end
""", ctes=HIST_CTE)
def d14(spark, sf):
    return Q.overlaps(hist(spark, sf), tie="budget_post")


@query("d15_date_consistency", """
SELECT 'period_parts' AS "check", count(*) AS value FROM periods WHERE period_seq_in_year % 7 = 0 OR period_seq_in_year % 5 = 0
UNION ALL
SELECT 'tx_vs_period', count(*) FROM ledger t JOIN periods p ON p.pay_date = t.pay_date
  WHERE t.pay_year <> year(p.pay_date) + CASE WHEN p.period_seq_in_year % 5 = 0 THEN 1 ELSE 0 END
""")
def d15(spark, sf):
    """Period parts with disturbed days (every 7th period) and years (every 5th), so both checks find rows."""
    seq = F.col("period_seq_in_year")
    p = fx.periods(spark, sf).withColumns({
        "pay_day": F.dayofmonth("pay_date") + F.when(seq % 7 == 0, 1).otherwise(0), "pay_month": F.month("pay_date"),
        "pay_year": F.year("pay_date") + F.when(seq % 5 == 0, 1).otherwise(0)})
    return Q.date_consistency(p, fx.ledger(spark, sf))


@query("d16_domain_checks", """
SELECT * FROM (
  SELECT 'day_range' AS rule, CAST(count(*) FILTER (WHERE NOT (day(pay_date) BETWEEN 1 AND 31)) AS BIGINT) AS n_violations FROM stg_lines
  UNION ALL SELECT 'month_range', count(*) FILTER (WHERE NOT (month(pay_date) BETWEEN 1 AND 12)) FROM stg_lines
  UNION ALL SELECT 'employer_negative', count(*) FILTER (WHERE employer_cents < 0) FROM stg_lines
  UNION ALL SELECT 'amount_zero', count(*) FILTER (WHERE amount_cents = 0) FROM stg_lines
  UNION ALL SELECT 'seq_range', count(*) FILTER (WHERE NOT (period_seq_in_year BETWEEN 1 AND 53)) FROM periods
  UNION ALL SELECT 'status_domain', count(*) FILTER (WHERE status NOT IN ('ouverte', 'fermée', 'archivée')) FROM periods) t
""")
def d16(spark, sf):
    return Q.domain_checks(fx.stg_lines(spark, sf), fx.periods(spark, sf))


@query("d17_gate_open", """
SELECT CASE WHEN p.status = 'ouverte' THEN 'ok' ELSE 'refused' END AS gate, count(*) AS n_lines,
  CAST(sum(l.amount_cents) AS BIGINT) AS cents
FROM stg_lines l LEFT JOIN periods p ON p.pay_date = l.pay_date GROUP BY 1
""")
def d17(spark, sf):
    g = Q.gate_open(fx.stg_lines(spark, sf), fx.periods(spark, sf))
    return g.groupBy("gate").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("amount_cents").cast("long").alias("cents"))


@query("d18_join_coverage", """
SELECT count(*) AS n_tx, count(s.hit) AS n_matched, round(count(s.hit) * 100.0 / count(*), 6) AS coverage_pct
FROM ledger t LEFT JOIN (SELECT DISTINCT source_file, source_row_no, 1 AS hit FROM staged WHERE is_valid) s
  ON s.source_file = t.source_file AND s.source_row_no = t.source_row_no
""", ctes=STAGED_CTE)
def d18(spark, sf):
    return Q.join_coverage(fx.ledger(spark, sf), staged(spark, sf).filter("is_valid"),
                           ["source_file", "source_row_no"])


@query("d19_diagnose_missing", """
SELECT CASE WHEN e.employee_id IS NULL THEN 'no_employee' WHEN i.pay_date IS NULL THEN 'null_date'
            WHEN i.amount_cents = 0 THEN 'zero_amount' WHEN d.done THEN 'already_done' ELSE 'missing' END AS diagnosis,
  count(*) AS n_lines
FROM stg_lines i LEFT JOIN (SELECT employee_id FROM employees) e ON e.employee_id = i.employee_id
LEFT JOIN (SELECT DISTINCT pay_date, source_file, source_row_no, true AS done FROM ledger2) d
  ON d.pay_date = i.pay_date AND d.source_file = i.source_file AND d.source_row_no = i.source_row_no
GROUP BY 1
""", ctes=STAGED_CTE + ",\n" + LEDGER2_CTE)
def d19(spark, sf):
    st = stored(staged(spark, sf).select(*IMPORT_COLUMNS), "staging")  # the import and the ledger built from it
    return Q.diagnose_missing(st, fx.employees(spark, sf), built_ledger(spark, sf, st),
                              ["pay_date", "source_file", "source_row_no"])


@query("d20_preview", """
SELECT pay_date, CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS brut,
  CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS deductions,
  CAST(sum(amount_cents) AS DOUBLE)/100.0 AS net, count(*) AS nb_lignes, count(DISTINCT employee_id) AS nb_employes
FROM stg_lines GROUP BY pay_date
""")
def d20(spark, sf):
    return Q.preview(fx.stg_lines(spark, sf))


@query("d20_preview_totals", """
SELECT count(*) AS nb_lignes, count(*) FILTER (WHERE pay_date IS NULL) AS dates_invalides,
  CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS brut,
  CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS deductions,
  CAST(sum(amount_cents) AS DOUBLE)/100.0 AS net, count(DISTINCT employee_id) AS nb_employes, count(DISTINCT pay_date) AS nb_dates
FROM stg_lines
""")
def d20t(spark, sf):
    return Q.preview_totals(fx.stg_lines(spark, sf))


SAMPLE = "batch_id, source_file, source_row_no, employee_id, pay_date, pay_code, amount_cents"


@query("d20_preview_sample", f"SELECT {SAMPLE} FROM stg_lines ORDER BY source_file, source_row_no, batch_id LIMIT 10")
def d20s(spark, sf):
    return Q.sample_rows(fx.stg_lines(spark, sf), ["source_file", "source_row_no", "batch_id"], 10).select(*SAMPLE.split(", "))


@query("d02_stage_preview", f"SELECT {SAMPLE}, is_valid FROM staged ORDER BY source_file, source_row_no, batch_id LIMIT 50", ctes=STAGED_CTE)
def d02p(spark, sf):
    return Q.sample_rows(staged(spark, sf), ["source_file", "source_row_no", "batch_id"], 50).select(*SAMPLE.split(", "), "is_valid")


@query("d03_commit_skipped", "SELECT batch_id, source_row_no, array_to_string(validation_errors, ',') AS issues FROM staged WHERE NOT is_valid",
       ctes=STAGED_CTE)
def d03s(spark, sf):
    _, skipped = Q.commit_split(staged(spark, sf))
    return skipped.select("batch_id", "source_row_no", F.array_join("validation_errors", ",").alias("issues"))


# ------------------------------------------------------------------------------ E

@query("e01_dim_time", """
SELECT date_paie, day(date_paie) AS jour_paie, month(date_paie) AS mois, year(date_paie) AS annee_paie,
  quarter(date_paie) AS trimestre, CASE WHEN month(date_paie) <= 6 THEN 1 ELSE 2 END AS semestre,
  strftime(date_paie, '%Y-%m') AS mois_paie, year(date_paie) AS exercice_fiscal,
  date_paie = last_day(date_paie) AS is_fin_mois, month(date_paie) IN (3, 6, 9, 12) AS is_fin_trimestre,
  month(date_paie) = 12 AS is_fin_annee
FROM (SELECT DISTINCT pay_date AS date_paie FROM staged WHERE is_valid AND pay_date IS NOT NULL) d
""", ctes=STAGED_CTE)
def e01(spark, sf):
    t = W.dim_time(staged(spark, sf).filter("is_valid"))
    return t.select("date_paie", *[F.col(c).cast("long").alias(c) for c in
                                   ("jour_paie", "mois", "annee_paie", "trimestre")],
                    F.col("semestre").cast("int").alias("semestre"), "mois_paie",
                    F.col("exercice_fiscal").cast("long").alias("exercice_fiscal"),
                    "is_fin_mois", "is_fin_trimestre", "is_fin_annee")


@query("e02_dim_employee", """
SELECT coalesce(n.employee_id, o.employee_id) AS employee_id, coalesce(n.budget_post, o.budget_post) AS budget_post
FROM (SELECT DISTINCT ON (employee_id) employee_id, budget_post FROM stg_lines WHERE batch_id = 1 AND employee_id IS NOT NULL
      ORDER BY employee_id, source_row_no) o
FULL OUTER JOIN (SELECT DISTINCT ON (employee_id) employee_id, budget_post FROM stg_lines WHERE batch_id = 2 AND employee_id IS NOT NULL
      ORDER BY employee_id, source_row_no) n ON n.employee_id = o.employee_id
""")
def e02(spark, sf):
    stg = fx.stg_lines(spark, sf)
    old = W.dim_employee(stg.filter("batch_id = 1"), attrs=("budget_post",))
    return W.dim_employee(stg.filter("batch_id = 2"), old, attrs=("budget_post",))


@query("e03_dim_code", "SELECT * FROM codedim", ctes=STAGED_CTE + ",\n" + CODEDIM_CTE)
def e03(spark, sf):
    return code_dim(spark, sf)


@query("e04_infer_codes", """
SELECT pay_code, pay_code AS label, CASE WHEN avg(amount_cents) >= 0 THEN 'Gains' ELSE 'Deductions' END AS categorie_paie
FROM staged WHERE is_valid AND pay_code IS NOT NULL AND pay_code <> '' AND pay_code NOT IN (SELECT pay_code FROM codes)
GROUP BY pay_code
""", ctes=STAGED_CTE)
def e04(spark, sf):
    return W.infer_codes(staged(spark, sf).filter("is_valid"), W.dim_code(fx.codes(spark)))


@query("e05_dim_budget_post", """
SELECT poste_budgetaire, string_split(poste_budgetaire, '-')[1] AS fonds, string_split(poste_budgetaire, '-')[2] AS fonction,
  string_split(poste_budgetaire, '-')[3] AS compte, string_split(poste_budgetaire, '-')[4] AS entite
FROM (SELECT DISTINCT coalesce(budget_post, 'N/A') AS poste_budgetaire FROM stg_lines) d
""")
def e05(spark, sf):
    return W.dim_budget_post(fx.stg_lines(spark, sf))


FACT_CTE = """fact AS (
  SELECT DISTINCT ON (s.cle_metier) s.cle_metier, s.pay_date, s.employee_id, s.pay_code, c.categorie_paie,
    coalesce(s.budget_post, 'N/A') AS poste_budgetaire, s.amount_cents, s.employer_cents, s.batch_id AS source_batch_id,
    s.source_file, s.source_row_no,
    c.categorie_paie = 'Gains' AND s.amount_cents < 0 AS is_adjustment,
    c.categorie_paie IN ('Deductions', 'Deductions_legales', 'Assurances', 'Syndicats') AND s.amount_cents > 0 AS is_refund,
    s.batch_id AS first_seen_batch_id
  FROM staged s JOIN codedim c ON c.pay_code = s.pay_code
  WHERE s.is_valid ORDER BY s.cle_metier, s.batch_id, s.source_row_no)"""


LOADS = ("2025-01-31 06:00:00", "2025-02-28 06:00:00")


def loaded_fact(spark, sf):
    """The fact after two loads: batch 1 into an empty fact, then the later batches into the stored one.

    The valid lines are written once, by batch, without their business key, which is long and does not compress: the two
    loads together compute it once a line. The dimensions and both loads read their columns."""
    lines = staged(spark, sf).filter("is_valid").drop("validation_errors", "is_valid", "categorie_paie", "cle_metier")
    valid = st = W.with_key(stored(lines, "staging", "batch_id")).withColumn("is_valid", F.lit(True))
    dims = {"codes_dim": code_dim(spark, sf, st), "time_dim": W.dim_time(valid), "employees_dim": W.dim_employee(valid, attrs=("pay_code",)),
            "posts_dim": W.dim_budget_post(valid)}
    dims = {name: stored(dim, name) for name, dim in dims.items()}  # both loads read them
    path = work_dir(spark, "fact")
    W.load_fact(st.filter("batch_id = 1"), **dims, loaded_at=LOADS[0]).write.parquet(f"{path}/load=1")
    first = spark.read.parquet(f"{path}/load=1")
    return first.unionByName(W.load_fact(st.filter("batch_id > 1"), **dims, fact=first, loaded_at=LOADS[1]))


STAMPED_FACT_CTE = FACT_CTE + f""",
stamped AS (SELECT *, CASE WHEN source_batch_id = 1 THEN TIMESTAMP '{LOADS[0]}' ELSE TIMESTAMP '{LOADS[1]}' END AS loaded_at FROM fact)"""


@query("e07_load_fact", "SELECT * FROM stamped", ctes=STAGED_CTE + ",\n" + CODEDIM_CTE + ",\n" + STAMPED_FACT_CTE)
def e07(spark, sf):
    return loaded_fact(spark, sf)


DEDUP_CTE = """dlog AS (
  SELECT cle_metier, batch_id, source_row_no, pay_date, employee_id, pay_code, amount_cents, fb AS first_seen_batch_id FROM (
    SELECT *, first_value(batch_id) OVER w AS fb, first_value(source_row_no) OVER w AS fr
    FROM staged WHERE is_valid WINDOW w AS (PARTITION BY cle_metier ORDER BY batch_id, source_row_no)) x
  WHERE NOT (batch_id = fb AND source_row_no = fr))"""


@query("e08_dedup_log", "SELECT * FROM dlog", ctes=STAGED_CTE + ",\n" + DEDUP_CTE)
def e08(spark, sf):
    return W.dedup_log(staged(spark, sf))


@query("e08_dedup_report", """
SELECT batch_id, pay_date, count(*) AS nb_doublons, CAST(sum(abs(amount_cents)) AS DOUBLE)/100.0 AS montant_total_ignore,
  count(DISTINCT pay_code) AS nb_codes, count(DISTINCT employee_id) AS nb_matricules,
  string_agg(DISTINCT pay_code, ', ' ORDER BY pay_code) AS codes_paie_concernes,
  string_agg(DISTINCT CAST(employee_id AS VARCHAR), ', ' ORDER BY CAST(employee_id AS VARCHAR)) AS matricules_concernes
FROM dlog GROUP BY batch_id, pay_date
""", ctes=STAGED_CTE + ",\n" + DEDUP_CTE)
def e08r(spark, sf):
    return W.dedup_report(W.dedup_log(staged(spark, sf)))


@query("e08_dedup_values", """
SELECT batch_id, pay_date, kind, value, count(*) AS nb_doublons FROM (
  SELECT batch_id, pay_date, 'code_paie' AS kind, pay_code AS value FROM dlog
  UNION ALL SELECT batch_id, pay_date, 'matricule', CAST(employee_id AS VARCHAR) FROM dlog) v
WHERE value IS NOT NULL GROUP BY ALL
""", ctes=STAGED_CTE + ",\n" + DEDUP_CTE)
def e08v(spark, sf):
    return W.dedup_values(W.dedup_log(staged(spark, sf)))


@query("e10_extract_employees", """
SELECT DISTINCT ON (employee_id) employee_id, batch_id, source_file, source_row_no, pay_date, pay_code, categorie_paie,
  amount_cents, employer_cents, budget_post
FROM stg_lines WHERE employee_id IS NOT NULL ORDER BY employee_id, source_row_no, batch_id
""")
def e10(spark, sf):
    stg = fx.stg_lines(spark, sf).withColumn("_ord", F.struct("source_row_no", "batch_id"))
    out = W.extract_employees(stg, row_col="_ord")
    return out.drop("_ord")


@query("e11_build_ledger", """
SELECT pay_date, employee_id, batch_id, source_file, source_row_no, pay_code, categorie_paie, amount_cents,
  employer_cents, budget_post, period_seq_in_year, pay_year FROM ledger2
""", ctes=STAGED_CTE + ",\n" + LEDGER2_CTE)
def e11(spark, sf):
    return built_ledger(spark, sf).select(
        "pay_date", "employee_id", "batch_id", "source_file", "source_row_no", "pay_code", "categorie_paie",
        "amount_cents", "employer_cents", "budget_post", "period_seq_in_year", "pay_year")


@query("e12_incremental_ledger", """
SELECT i.batch_id, i.source_file, i.source_row_no, i.pay_date, i.employee_id, i.amount_cents
FROM stg_lines i JOIN (SELECT employee_id AS known_id FROM employees) e ON e.known_id = i.employee_id
LEFT JOIN (SELECT DISTINCT pay_date, source_file, source_row_no, true AS done FROM ledger2) d
  ON d.pay_date = i.pay_date AND d.source_file = i.source_file AND d.source_row_no = i.source_row_no
WHERE d.done IS NULL
""", ctes=STAGED_CTE + ",\n" + LEDGER2_CTE)
def e12(spark, sf):
    st = stored(staged(spark, sf).select(*IMPORT_COLUMNS), "staging")
    out = W.incremental_ledger(st, fx.employees(spark, sf), built_ledger(spark, sf, st))
    return out.select("batch_id", "source_file", "source_row_no", "pay_date", "employee_id", "amount_cents")


E13_CTE = """old AS (
  SELECT pay_date, CAST(dense_rank() OVER (PARTITION BY year(pay_date) ORDER BY pay_date) AS INT) AS period_seq_in_year,
    'ouverte' AS status
  FROM (SELECT DISTINCT pay_date FROM stg_lines WHERE batch_id = 2 AND pay_date IS NOT NULL) d),
mx AS (SELECT year(pay_date) AS y, max(period_seq_in_year) AS m FROM old GROUP BY 1)"""


@query("e13_ensure_periods", """
SELECT * FROM old
UNION ALL
SELECT pay_date, CAST(coalesce(mx.m, 0) + row_number() OVER (PARTITION BY year(pay_date) ORDER BY pay_date) AS INT),
  'ouverte'
FROM (SELECT DISTINCT pay_date FROM ledger WHERE pay_date NOT IN (SELECT pay_date FROM old)) n
LEFT JOIN mx ON mx.y = year(n.pay_date)
""", ctes=E13_CTE)
def e13(spark, sf):
    stg2 = fx.stg_lines(spark, sf).filter("batch_id = 2")
    old = W.period_sequence(stg2).withColumn("status", F.lit("ouverte"))
    return W.ensure_periods(fx.ledger(spark, sf), old)


@query("e15_delete_period", """
SELECT d AS pay_date, (SELECT count(*) FROM ledger WHERE pay_date = d) AS lines_deleted,
  (SELECT count(DISTINCT employee_id) FROM ledger WHERE pay_date = d) AS employees_touched,
  (SELECT count(*) FROM batches WHERE pay_date = d) AS batches_deleted,
  (SELECT count(*) FROM employees e WHERE employee_id IN (SELECT employee_id FROM ledger WHERE pay_date = d)
     AND employee_id NOT IN (SELECT employee_id FROM ledger WHERE pay_date <> d)) AS future_orphans
FROM (SELECT min(pay_date) AS d FROM ledger) x
""")
def e15(spark, sf):
    lg = fx.ledger(spark, sf)
    first = lg.agg(F.min("pay_date")).scalar()
    res = W.delete_period(lg, fx.batches(spark, sf), fx.employees(spark, sf), fx.periods(spark, sf), first)
    return res["audit"]


@query("d02_stage_fields", f"""
SELECT field, n_issues, total_rows, rows_clean, rows_with_issues FROM (
  SELECT split_part(issue, ':', 1) AS field, count(*) AS n_issues
  FROM (SELECT unnest(issues) AS issue FROM sf) u GROUP BY 1) f,
  (SELECT count(*) AS total_rows, count(*) FILTER (WHERE len(issues) = 0) AS rows_clean,
     count(*) FILTER (WHERE len(issues) > 0) AS rows_with_issues FROM sf) t
""", ctes=PAYFILE_CTE + """,
sf AS (SELECT list_filter([
    CASE WHEN """ + parse_date(q('date de paie'), 1990, 2100) + """ IS NULL THEN 'date_paie: valeur vide' END,
    CASE WHEN """ + amount_cents(q('montant')) + """ IS NULL THEN 'montant: valeur vide' END,
    CASE WHEN trim(""" + q('employé') + """) IS NULL OR trim(""" + q('employé') + """) = '' THEN 'fullname: valeur vide' END],
  lambda x: x IS NOT NULL) AS issues FROM payfile)""")
def d02f(spark, sf):
    from paysift.functions.amounts import amount_to_decimal
    from paysift.functions.dates import WIDE_YEAR_HI, WIDE_YEAR_LO, parse_pay_date
    from paysift.sources.payfile import raw_pay_file
    specs = {"date_paie": ("date de paie", lambda c: parse_pay_date(c, WIDE_YEAR_LO, WIDE_YEAR_HI)),
             "montant": ("montant", amount_to_decimal),
             "fullname": ("employé", lambda c: F.trim(c))}
    staged_ = Q.stage_fields(raw_pay_file(spark, sf), specs, "N de ligne")
    return Q.stage_field_stats(staged_)


@query("e13_period_status", """
SELECT p.pay_date, p.period_seq_in_year, CASE WHEN year(p.pay_date) <= 1996 THEN 'archivée' ELSE p.status END AS status
FROM periods p
""")
def e13s(spark, sf):
    per = fx.periods(spark, sf)
    changes = per.filter(F.year("pay_date") <= 1996).select("pay_date", F.lit("archivée").alias("status"))
    return W.with_status(per, changes)


@query("e15_remaining_tables", """
SELECT 'ledger' AS "table", count(*) AS n FROM ledger, d WHERE pay_date <> first
UNION ALL SELECT 'batches', count(*) FROM batches, d WHERE pay_date <> first
UNION ALL SELECT 'periods', count(*) FROM periods, d WHERE pay_date <> first
UNION ALL SELECT 'employees', count(*) FROM employees, d WHERE NOT (
  employee_id IN (SELECT employee_id FROM ledger, d WHERE pay_date = first)
  AND employee_id NOT IN (SELECT employee_id FROM ledger, d WHERE pay_date <> first))
""", ctes="d AS (SELECT min(pay_date) AS first FROM ledger)")
def e15r(spark, sf):
    lg = fx.ledger(spark, sf)
    res = W.delete_period(lg, fx.batches(spark, sf), fx.employees(spark, sf), fx.periods(spark, sf), lg.agg(F.min("pay_date")).scalar())
    counts = [res[t].agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n")) for t in ("ledger", "batches", "periods", "employees")]
    return fx.union_all(counts)
