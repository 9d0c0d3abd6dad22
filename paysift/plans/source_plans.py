"""Sources and sinks (A1, A5-A9, A11-A14, E9) and text/vector queries (L1-L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.operators import kpi
from paysift.operators import reports as R
from paysift.operators import vectors as V
from paysift.operators.lines import number_lines
from paysift.sources import documents as DOC
from paysift.sources import fixtures as fx
from paysift.sources import params as PR
from paysift.sources import sinks as SK
from paysift.sources.payfile import FILE_HEADERS, land_pay_file, raw_pay_file, read_pay_csv
from paysift.sources.tables import read_table

from .catalog import query
from .analytics_plans import CANON_CTE, canon_lines
from .profile_plans import PAYFILE_CTE, q
from .quality_plans import CODEDIM_CTE, STAGED_CTE, STAMPED_FACT_CTE, loaded_fact, staged
from .report_plans import _deltas_sql
from .sqltext import STAR_INNER, STAR_OUTER


@query("a01_read_pay_csv", f"SELECT {', '.join(q(h) for h in FILE_HEADERS)}, source_file FROM payfile",
       ctes=PAYFILE_CTE)
def a01(spark, sf):
    path = SK.work_dir(spark, "landing")
    land_pay_file(spark, sf, path)
    df = read_pay_csv(spark, path)
    return df.select(*[F.col(f"`{h}`") for h in FILE_HEADERS], "source_file")


@query("a05_append_lines", """
SELECT 'run-1' AS import_run_id, pay_year, count(*) AS n FROM ledger GROUP BY pay_year
UNION ALL SELECT 'run-2', pay_year, count(*) FROM ledger WHERE pay_year = 1998 GROUP BY pay_year
""")
def a05(spark, sf):
    path = SK.work_dir(spark, "appended")
    lg = fx.ledger(spark, sf)
    SK.append_lines(lg, path, "run-1")
    SK.append_lines(lg.filter(F.col("pay_year") == F.lit(1998)), path, "run-2")
    SK.append_lines(lg.filter(F.col("pay_year") == F.lit(1998)), path, "run-2")  # a retried run replaces itself
    return spark.read.parquet(path).groupBy("import_run_id", "pay_year").agg(F.count(F.lit(1)).alias("n"))


@query("a06_batch_log", """
SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid) AS rejected,
  CAST(sum(len(validation_errors)) AS BIGINT) AS alerts,
  CASE WHEN count(*) FILTER (WHERE is_valid) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE NOT is_valid) > 0
       THEN 'completed_with_errors' ELSE 'completed' END AS status
FROM staged GROUP BY batch_id
""", ctes=STAGED_CTE)
def a06(spark, sf):
    return SK.batch_log(staged(spark, sf))


@query("a07_file_checksums", """
SELECT source_file, count(*) AS n_lines, false AS seen_before FROM ledger
WHERE source_file > (SELECT min(source_file) FROM ledger) GROUP BY source_file
""")
def a07(spark, sf):
    """Landing folder with every file twice, the first file imported before: each other file is new once."""
    path = SK.work_dir(spark, "checksums")
    # lines are brought to their file once, before they are texts, and each task writes both copies of its files
    (raw_pay_file(spark, sf, lambda lines: lines.repartition("pay_date")).withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"))))
     .sortWithinPartitions("copy", "source_file", F.col("`N de ligne`").cast("long"))
     .write.option("header", True).option("sep", ";").partitionBy("copy", "source_file").csv(path))
    period = F.regexp_extract("file_path", r"source_file=([^/]+)", 1)
    cur = SK.file_checksums(spark, f"{path}/*/*/*.csv").withColumn("period", period)
    seen = cur.filter(F.col("period") == cur.agg(F.min("period")).scalar())
    new = SK.new_files(cur, seen).select("period", "file_path")
    lines = spark.read.option("header", True).option("sep", ";").csv(f"{path}/*/*").select(F.col("_metadata.file_path").alias("_p"))
    name = F.regexp_extract(F.col("_p"), r"([^/]+/source_file=[^/]+)/", 1)
    counts = lines.groupBy(name.alias("_k")).agg(F.count(F.lit(1)).alias("n_lines"))
    j = new.withColumn("_k", F.regexp_extract("file_path", r"([^/]+/source_file=[^/]+)/", 1)).join(counts, "_k")
    return j.select(F.col("period").alias("source_file"), "n_lines", F.lit(False).alias("seen_before"))


@query("a08_write_report", """
SELECT date_paie, CAST(sum(montant_combine) AS DOUBLE)/100.0 AS total_combine,
  CAST(sum(CASE WHEN categorie_paie = 'Gains' THEN montant_employe ELSE 0 END) AS DOUBLE)/100.0 AS gains,
  CAST(sum(CASE WHEN strip_accents(lower(categorie_paie)) LIKE 'deduction%' THEN montant_employe ELSE 0 END) AS DOUBLE)/100.0
    AS deductions,
  CAST(sum(part_employeur) AS DOUBLE)/100.0 AS part_employeur
FROM canon GROUP BY date_paie
""", ctes=CANON_CTE)
def a08(spark, sf):
    from paysift.operators import analytics as an
    from .analytics_plans import canon_lines
    path = SK.work_dir(spark, "report")
    SK.write_report(an.pay_mass(canon_lines(spark, sf)), path, "json")
    return spark.read.schema("date_paie date, total_combine double, gains double, deductions double, "
                             "part_employeur double").json(path)


@query("a09_write_ledger", "SELECT pay_year, count(*) AS n FROM ledger GROUP BY pay_year")
def a09(spark, sf):
    path = SK.work_dir(spark, "ledger")
    lg = fx.ledger(spark, sf)
    SK.write_ledger(lg, path)
    SK.write_ledger(lg.filter(F.col("pay_year") == 1997), path)  # reload one year only
    return spark.read.parquet(path).groupBy("pay_year").agg(F.count(F.lit(1)).alias("n"))


@query("e09_replace_batch", "SELECT batch_id, count(*) AS n FROM stg_lines GROUP BY batch_id")
def e09(spark, sf):
    path = SK.work_dir(spark, "batches")
    st = fx.stg_lines(spark, sf)
    SK.replace_batch(st, path)
    SK.replace_batch(st.filter("batch_id = 2"), path)
    return spark.read.parquet(path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("a11_v_imported", f"""
SELECT trim(matricule) AS matricule, trim({q('employé')}) AS nom, trim({q('code de paie')}) AS code_paie,
  trim({q('montant')}) AS montant, trim({q('date de paie')}) AS date_paie, source_file FROM payfile
""", ctes=PAYFILE_CTE)
def a11(spark, sf):
    p = raw_pay_file(spark, sf)
    return p.select(F.trim("matricule").alias("matricule"), F.trim("`employé`").alias("nom"),
                    F.trim("`code de paie`").alias("code_paie"), F.trim("montant").alias("montant"),
                    F.trim("`date de paie`").alias("date_paie"), "source_file")


@query("a11_v_ledger_compat", """
SELECT t.source_row_no, e.matricule_norm AS matricule, e.nom_complet AS nom, t.pay_date AS date_paie, t.pay_code AS code_paie,
  CAST(t.amount_cents AS DOUBLE)/100.0 AS montant
FROM ledger t JOIN employees e ON e.employee_id = t.employee_id
""")
def a11l(spark, sf):
    t = fx.ledger(spark, sf)
    e = fx.employees(spark, sf).select("employee_id", "matricule_norm", "nom_complet")
    return t.join(e, "employee_id").select("source_row_no", F.col("matricule_norm").alias("matricule"),
                                           F.col("nom_complet").alias("nom"), F.col("pay_date").alias("date_paie"),
                                           F.col("pay_code").alias("code_paie"),
                                           kpi.dollars("amount_cents").alias("montant"))


@query("a12_snapshot_store", """
SELECT c.pay_date, salaire_net_total, masse_salariale, deductions, salaire_net_total / nb_employes AS net_moyen,
  nb_employes, nb_transactions, least(n_codes, 10) AS n_codes_top
FROM (SELECT pay_date, CAST(sum(amount_cents) AS DOUBLE)/100.0 AS salaire_net_total,
        CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS masse_salariale,
        CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS deductions,
        count(DISTINCT employee_id) AS nb_employes, count(*) AS nb_transactions, count(DISTINCT pay_code) AS n_codes
      FROM ledger GROUP BY pay_date) c
""")
def a12(spark, sf):
    path = SK.work_dir(spark, "snapshots")
    lg = fx.ledger(spark, sf)
    SK.snapshot_upsert(SK.snapshot_frame(lg), path)
    latest = lg.agg(F.max("pay_date")).scalar()
    SK.snapshot_upsert(SK.snapshot_frame(lg.filter(F.col("pay_date") == latest)), path)
    return SK.snapshot_get(spark, path)


@query("a12_snapshot_documents", """
SELECT c.pay_date, salaire_net_total, masse_salariale, deductions, salaire_net_total / nb_employes AS net_moyen,
  nb_employes, nb_transactions, least(n_codes, 10) AS n_codes_top
FROM (SELECT pay_date, CAST(sum(amount_cents) AS DOUBLE)/100.0 AS salaire_net_total,
        CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS masse_salariale,
        CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS deductions,
        count(DISTINCT employee_id) AS nb_employes, count(*) AS nb_transactions, count(DISTINCT pay_code) AS n_codes
      FROM ledger GROUP BY pay_date) c
""")
def a12d(spark, sf):
    """Snapshots stored as VARIANT documents and read back by path."""
    out = SK.work_dir(spark, "snapshot-docs")
    DOC.store_documents(DOC.snapshot_documents(fx.ledger(spark, sf)), out)
    return DOC.snapshot_figures(DOC.read_documents(spark, out))


@query("e15_audit_documents", """
SELECT d AS pay_date, 'ledger' AS "table", (SELECT count(*) FROM ledger) AS rows_before, (SELECT count(*) FROM ledger WHERE pay_date <> d) AS rows_after,
  (SELECT CAST(sum(amount_cents) AS BIGINT) FROM ledger) AS cents_before, (SELECT CAST(sum(amount_cents) AS BIGINT) FROM ledger WHERE pay_date <> d) AS cents_after
FROM (SELECT min(pay_date) AS d FROM ledger) x
UNION ALL SELECT d, 'batches', (SELECT count(*) FROM batches), (SELECT count(*) FROM batches WHERE pay_date <> d), NULL, NULL
FROM (SELECT min(pay_date) AS d FROM ledger) x
""")
def e15_docs(spark, sf):
    """Audit of the first pay date's deletion with before and after documents."""
    lg, batches = fx.ledger(spark, sf), fx.batches(spark, sf)
    first = lg.agg(F.min("pay_date")).first()[0]
    of = {"ledger": lg, "batches": batches}
    out = SK.work_dir(spark, "audit")
    DOC.audit_documents({n: t.filter(F.col("pay_date") == first) for n, t in of.items()},
                        {n: t.filter(F.col("pay_date") != first) for n, t in of.items()}, first).write.parquet(out)
    a = spark.read.parquet(out)
    return a.select("pay_date", "table", *[DOC.path(w, f"$.{c}", "bigint").alias(f"{c}_{w}") for c in ("rows", "cents") for w in ("before", "after")])


SNAPSHOT_SQL = """SELECT c.pay_date, salaire_net_total, masse_salariale, deductions, salaire_net_total / nb_employes AS net_moyen,
  nb_employes, nb_transactions, least(n_codes, 10) AS n_codes_top, CASE WHEN year(c.pay_date) >= 1997 THEN 'snapshot' ELSE 'live' END AS source
FROM (SELECT pay_date, CAST(sum(amount_cents) AS DOUBLE)/100.0 AS salaire_net_total,
        CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS masse_salariale,
        CAST(sum(CASE WHEN amount_cents < 0 THEN amount_cents ELSE 0 END) AS DOUBLE)/100.0 AS deductions,
        count(DISTINCT employee_id) AS nb_employes, count(*) AS nb_transactions, count(DISTINCT pay_code) AS n_codes
      FROM ledger GROUP BY pay_date) c"""


@query("a12_snapshot_or_live", SNAPSHOT_SQL)
def a12l(spark, sf):
    """Snapshots stored from 1997 on; earlier dates are computed live."""
    path, lg = SK.work_dir(spark, "snapshots"), fx.ledger(spark, sf)
    SK.snapshot_upsert(SK.snapshot_frame(lg.filter(F.col("pay_year") >= 1997)), path)
    return SK.snapshot_or_live(spark, path, lg, "1 hour")


@query("a11_v_period_compat", f"""
SELECT date_paie, gains_brut AS brut, deductions_net AS deductions_employe, net_a_payer AS net, part_employeur, cout_employeur_pnl,
  cash_out_total, nb_employes, ajustements_gains, deductions_brutes, remboursements
FROM (SELECT date_paie, {STAR_OUTER} FROM (SELECT pay_date AS date_paie, {STAR_INNER} FROM stamped GROUP BY pay_date) t) k
""", ctes=STAGED_CTE + ",\n" + CODEDIM_CTE + ",\n" + STAMPED_FACT_CTE)
def a11p(spark, sf):
    return kpi.v_period_compat(kpi.kpi_star(loaded_fact(spark, sf)))


@query("a08_report_exports", """
SELECT 'summary' AS report, 5 * count(DISTINCT date_paie) AS n_rows FROM canon
UNION ALL SELECT 'employee_detail', count(*) FROM (SELECT DISTINCT date_paie, matricule, nom_employe FROM canon) x
UNION ALL SELECT 'by_code', count(*) FROM (SELECT DISTINCT date_paie, code_paie, description_code_paie FROM canon) x
UNION ALL SELECT 'by_post', count(*) FROM (SELECT DISTINCT date_paie, poste_budgetaire FROM canon) x
UNION ALL SELECT 'evolution_12', least(12, count(DISTINCT strftime(date_paie, '%Y-%m'))) FROM canon
UNION ALL SELECT 'anomalies', count(DISTINCT strftime(date_paie, '%Y-%m')) FROM canon WHERE montant_combine <> 0
UNION ALL SELECT 'comparison', count(*) FROM dl_code_paie
""", ctes=CANON_CTE + ",\n" + _deltas_sql("code_paie"))
def a08e(spark, sf):
    """The seven exports written as CSV folders and counted from what is read back; the lines are derived once for all seven."""
    lines, emp = SK.stored(canon_lines(spark, sf).drop("source_file"), "report-lines"), fx.employees(spark, sf)
    reports = {"summary": R.report_summary(lines, emp), "employee_detail": R.report_employee_pivot(lines, emp), "by_code": R.report_by_code(lines),
               "by_post": R.report_by_post(lines), "evolution_12": R.evolution(lines, 12), "anomalies": R.anomaly_set(lines, emp),
               "comparison": R.period_deltas_by(lines, "code_paie")}
    path = SK.work_dir(spark, "reports")
    for name, df in reports.items():
        SK.write_report(df, f"{path}/{name}", "csv")
    return fx.union_all([spark.read.schema(df.schema).option("header", True).csv(f"{path}/{n}").agg(
        F.lit(n).alias("report"), F.count(F.lit(1)).alias("n_rows")) for n, df in reports.items()])


@query("a13_row_numbers", """
SELECT source_file, source_row_no, row_number() OVER (ORDER BY source_file, source_row_no) AS line_no,
  row_number() OVER (PARTITION BY source_file ORDER BY source_row_no) + 1 AS file_row_no
FROM ledger
""")
def a13(spark, sf):
    lg = fx.ledger(spark, sf).select("source_file", "source_row_no")
    return number_lines(lg, in_file="file_row_no")


@query("a14_params_upsert", """
SELECT * FROM (VALUES ('part_employeur_taux', CAST(0.15 AS DOUBLE), CAST(NULL AS VARCHAR)),
                      ('use_sign_fallback', CAST(1 AS DOUBLE), CAST(NULL AS VARCHAR))) AS o(param_key, value_num, value_text)
UNION ALL
SELECT 'nb_lignes_ledger', CAST(count(*) AS DOUBLE), CAST(NULL AS VARCHAR) FROM ledger
UNION ALL
SELECT 'taux_part_employeur_observe',
  round(CAST(sum(employer_cents) AS DOUBLE) / CAST(sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS DOUBLE), 6),
  CAST(NULL AS VARCHAR) FROM ledger
""")
def a14(spark, sf):
    """Observed parameters (line count, employer-share rate) upserted over the seeded table."""
    lg = fx.ledger(spark, sf)
    a = F.col("amount_cents")
    obs = lg.agg(F.count(F.lit(1)).cast("double").alias("n"),
                 F.round(F.sum("employer_cents").cast("double")
                         / F.sum(F.when(a > 0, a).otherwise(0)).cast("double"), 6).alias("r"))
    new = obs.select(F.explode(F.array(
        F.struct(F.lit("nb_lignes_ledger").alias("param_key"), F.col("n").alias("value_num")),
        F.struct(F.lit("taux_part_employeur_observe").alias("param_key"), F.col("r").alias("value_num"))))
        .alias("p")).select("p.*", F.lit(None).cast("string").alias("value_text"))
    return PR.upsert(PR.params(spark), new, ["param_key"])


CHUNK_SQL = """SELECT doc_id, CAST(doc_id AS VARCHAR) AS path,
  CASE WHEN n_chunks > 1 THEN printf('%s [part %d/%d]', CAST(doc_id AS VARCHAR), i + 1, n_chunks) ELSE CAST(doc_id AS VARCHAR) END AS title,
  lang AS kind, i + 1 AS chunk_no, n_chunks, substring(t, s + 1, {size}) AS content
FROM (SELECT doc_id, lang, t, n_chunks, unnest(starts) AS s, generate_subscripts(starts, 1) - 1 AS i FROM (
  SELECT doc_id, lang, t, CASE WHEN length(t) <= {size} THEN [0] ELSE generate_series(0, length(t) - 1, {step}) END AS starts,
    len(CASE WHEN length(t) <= {size} THEN [0] ELSE generate_series(0, length(t) - 1, {step}) END) AS n_chunks
  FROM (SELECT doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) d WHERE length(t) > 0) x) y"""


@query("l01_chunk_documents", CHUNK_SQL.format(size=1800, step=1600))
def l01(spark, sf):
    return V.chunk(read_table(spark, sf, "documents"), kind_col="lang")


@query("l02_upsert_chunks", f"""
SELECT * FROM ({CHUNK_SQL.format(size=2400, step=2100)}) o
WHERE NOT EXISTS (SELECT 1 FROM ({CHUNK_SQL.format(size=1800, step=1600)}) n
                  WHERE n.path = o.path AND n.title = o.title AND n.kind = o.kind)
UNION ALL {CHUNK_SQL.format(size=1800, step=1600)}
""")
def l02(spark, sf):
    docs = read_table(spark, sf, "documents")
    return V.upsert_chunks(V.chunk(docs, kind_col="lang"), V.chunk(docs, size=2400, overlap=300, kind_col="lang"))


@query("l03_cosine_topk", """
SELECT vec_id, label, round(
  list_reduce(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)), lambda a, b: a + b, 0.0)
  / ((CASE WHEN sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0)) = 0
      THEN 1.0 ELSE sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0)) END)
   * (CASE WHEN sqrt(list_reduce(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0)) = 0
      THEN 1.0 ELSE sqrt(list_reduce(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0)) END)), 6) AS score
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) qq
ORDER BY score DESC, vec_id LIMIT 8
""")
def l03(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    first = emb.agg(F.min("vec_id")).scalar()
    query_vec = emb.filter(F.col("vec_id") == first).select(F.col("embedding").alias("q"))
    return V.cosine_topk(emb, query_vec, k=8)


_UNIT = "sqrt(list_reduce(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0))"


@query("l03_cosine_topk_many", f"""
SELECT query_id, vec_id, label, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
    SELECT query_id, vec_id, label, round(
      list_reduce(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)), lambda a, b: a + b, 0.0) / (nv * nq), 6) AS score
    FROM (SELECT vec_id, label, embedding, coalesce(nullif({_UNIT.format(v='embedding')}, 0), 1.0) AS nv FROM embeddings) e,
         (SELECT vec_id AS query_id, embedding AS q, coalesce(nullif({_UNIT.format(v='embedding')}, 0), 1.0) AS nq FROM embeddings WHERE vec_id % 20 = 0) s) x) y
WHERE r <= 8
""")
def l03_many(spark, sf):
    """Every vector whose id is divisible by 20 against all vectors."""
    emb = read_table(spark, sf, "embeddings")
    return V.cosine_topk(emb, emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k=8)


SYN_CTE = """syn AS (SELECT * FROM (VALUES ('Gains', ['gains', 'revenu', 'salaire', 'brut', 'base']),
    ('Deductions', ['deductions', 'retenues', 'retenue', 'debit'])) AS v(categorie, synonyms))"""


@query("a14_category_synonyms", """
SELECT c.code_paie, c.description_code_paie, s.categorie, count(*) AS lignes
FROM canon c LEFT JOIN (SELECT categorie, unnest(synonyms) AS syn FROM syn) s ON lower(trim(c.description_code_paie)) = s.syn
GROUP BY 1, 2, 3
""", ctes=CANON_CTE + ",\n" + SYN_CTE)
def a14s(spark, sf):
    from .analytics_plans import canon_lines
    lines = PR.categorise(canon_lines(spark, sf), "description_code_paie", PR.synonyms(spark))
    return lines.groupBy("code_paie", "description_code_paie", "categorie").agg(F.count(F.lit(1)).alias("lignes"))
