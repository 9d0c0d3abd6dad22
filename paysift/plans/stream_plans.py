"""Streaming queries M1-M3: the stream runs to completion (availableNow) over files derived
from the driver tables, then the sink is read back as a DataFrame."""

from __future__ import annotations

from paysift.operators import warehouse as W
from paysift.sources import fixtures as fx
from paysift.sources.payfile import land_pay_file
from paysift.sources.sinks import work_dir
from paysift.streaming import ingest as M

from .catalog import query
from .profile_plans import PAYFILE_CTE, q
from .quality_plans import STAGED_CTE
from .sqltext import amount_cents, parse_date


def _staging_files(spark, sf):
    """stg_lines written as one parquet folder per batch (arrival order = batch order)."""
    path = work_dir(spark, "stg-files")
    st = fx.stg_lines(spark, sf)
    st.write.mode("overwrite").partitionBy("batch_id").parquet(path)
    schema = spark.read.parquet(path).schema
    return path, schema


M1_SQL = f"""
SELECT source_row_no, matricule, pay_date, pay_code, categorie_paie, budget_post, amount_cents, employer_cents,
  CAST(year(pay_date) AS INT) AS pay_year
FROM (SELECT TRY_CAST({q('N de ligne')} AS BIGINT) AS source_row_no, trim(matricule) AS matricule,
        {parse_date(q('date de paie'), 1990, 2100)} AS pay_date, trim({q('code de paie')}) AS pay_code,
        {q('catégorie de paie')} AS categorie_paie, {q('poste budgétaire')} AS budget_post,
        {amount_cents(q('montant'))} AS amount_cents, {amount_cents(q('part employeur'))} AS employer_cents
      FROM payfile) x
WHERE pay_date IS NOT NULL AND matricule IS NOT NULL AND trim(matricule) <> '' AND pay_code IS NOT NULL
  AND trim(pay_code) <> '' AND amount_cents IS NOT NULL AND coalesce(employer_cents, 0) >= 0
  AND pay_date IN (SELECT pay_date FROM periods WHERE status = 'ouverte')
"""


@query("m01_stream_ingest", M1_SQL, ctes=PAYFILE_CTE)
def m01(spark, sf):
    landing, out, ck = work_dir(spark, "m1-landing"), work_dir(spark, "m1-out"), work_dir(spark, "m1-ckpt")
    dates = land_pay_file(spark, sf, landing)
    M.stream_ingest(spark, landing, out, ck, periods=fx.periods_of(dates))
    return M.published(spark, out, "lines").drop("epoch", "attempt", "file_path")


@query("m01_stream_fact", f"""
SELECT DISTINCT md5(concat_ws('|', CAST(pay_date AS VARCHAR), mat, pay_code, coalesce(budget_post, 'N/A'),
    CAST(amount_cents AS VARCHAR), coalesce(CAST(employer_cents AS VARCHAR), '0'))) AS cle_metier,
  pay_date, mat AS employee_id, pay_code, c.categorie AS categorie_paie, coalesce(budget_post, 'N/A') AS poste_budgetaire, amount_cents, employer_cents,
  c.categorie = 'Gains' AND amount_cents < 0 AS is_adjustment,
  c.categorie IN ('Deductions', 'Deductions_legales', 'Assurances', 'Syndicats') AND amount_cents > 0 AS is_refund
FROM (SELECT *, upper(CASE WHEN regexp_full_match(m, '[0-9]+') THEN CASE WHEN ltrim(m, '0') = '' THEN '0' ELSE ltrim(m, '0') END ELSE m END) AS mat
      FROM (SELECT *, regexp_replace(matricule, '[^0-9A-Za-z-]', '', 'g') AS m FROM ({M1_SQL}) a) b) l
JOIN codes c USING (pay_code)
""", ctes=PAYFILE_CTE)
def m01f(spark, sf):
    """Arriving files through to the fact; each file comes in four pieces, a part of them an epoch, so that later epochs meet
    stored keys of their dates."""
    landing, out, ck = work_dir(spark, "m1f-landing"), work_dir(spark, "m1f-out"), work_dir(spark, "m1f-ckpt")
    dates = land_pay_file(spark, sf, landing, deliveries=4, compression="gzip")
    M.stream_ingest(spark, landing, out, ck, max_files=500, periods=fx.periods_of(dates), codes_dim=W.dim_code(fx.codes(spark)))
    return M.published(spark, out, "fact").select(
        "cle_metier", "pay_date", "employee_id", "pay_code", "categorie_paie", "poste_budgetaire", "amount_cents", "employer_cents", "is_adjustment", "is_refund")


@query("m02_stream_dedup", "SELECT DISTINCT cle_metier FROM staged WHERE is_valid", ctes=STAGED_CTE)
def m02(spark, sf):
    src, schema = _staging_files(spark, sf)
    out, ck = work_dir(spark, "m2-out"), work_dir(spark, "m2-ckpt")
    M.stream_dedup(spark, src, schema, out, ck)
    return spark.read.parquet(out).select("cle_metier")


@query("m03_stream_kpi", """
SELECT l.pay_date, CAST(sum(l.amount_cents) AS BIGINT) AS net_cents, count(*) AS n_lines
FROM stg_lines l JOIN periods p ON p.pay_date = l.pay_date AND p.status = 'ouverte'
GROUP BY l.pay_date
""")
def m03(spark, sf):
    src, schema = _staging_files(spark, sf)
    out, ck = work_dir(spark, "m3-out"), work_dir(spark, "m3-ckpt")
    M.stream_kpi(spark, src, schema, fx.periods(spark, sf), out, ck)
    return M.latest_kpi(spark, out)



@query("m03_stream_kpi_month", """
SELECT strftime(l.pay_date, '%Y-%m') AS mois, CAST(sum(l.amount_cents) AS BIGINT) AS net_cents, count(*) AS n_lines
FROM stg_lines l JOIN periods p ON p.pay_date = l.pay_date AND p.status = 'ouverte'
GROUP BY 1
""")
def m03m(spark, sf):
    src, schema = _staging_files(spark, sf)
    out, ck = work_dir(spark, "m3m-out"), work_dir(spark, "m3m-ckpt")
    M.stream_kpi_month(spark, src, schema, fx.periods(spark, sf), out, ck)
    return M.latest_kpi(spark, out).withColumnRenamed("pay_date", "mois")
