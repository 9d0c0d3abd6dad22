"""DuckDB text of the fixture views (oracle side).

Same views as ``paysift.sources.fixtures`` (FIXTURES.md), in DuckDB dialect:
integer division ``//`` and ``date_diff`` for the Excel serial. An oracle query
is the chain of the CTEs it needs followed by its SELECT.
"""

from __future__ import annotations

import re

DEPS = {
    "ledger": [], "employees": [], "codes": [], "sign_policies": [],
    "periods": ["ledger"], "batches": ["ledger"], "raw_lines": ["ledger"], "stg_lines": ["ledger"],
}
ORDER = ["ledger", "employees", "periods", "batches", "codes", "sign_policies", "raw_lines",
         "stg_lines"]

CTE = {}

CTE['ledger'] = """\
l AS (
  SELECT *, l_orderkey*1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS source_row_no
  FROM lineitem),
b AS (
  SELECT l.source_row_no, o_custkey AS employee_id,
    CAST(CASE WHEN day(o_orderdate) <= 15 THEN date_trunc('month', o_orderdate) + INTERVAL 14 DAY
         ELSE last_day(CAST(o_orderdate AS DATE)) END AS DATE) AS pay_date,
    CASE l_linenumber WHEN 1 THEN '101' WHEN 2 THEN '105' WHEN 3 THEN '106_AJUST' WHEN 4 THEN '450'
         WHEN 5 THEN '520' WHEN 6 THEN '701' ELSE '580_REMBOURSE' END AS pay_code,
    CASE WHEN l_linenumber <= 3 THEN 'Gains' WHEN l_linenumber = 4 THEN 'Deductions_legales'
         WHEN l_linenumber = 5 THEN 'Syndicats' WHEN l_linenumber = 6 THEN 'Assurances' ELSE 'Deductions' END AS categorie_paie,
    CAST(round(l_extendedprice*100) AS BIGINT) AS base, CAST(round(l_tax*100) AS BIGINT) AS tx,
    l_returnflag, l_suppkey, p_brand
  FROM l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
ledger AS (
  SELECT source_row_no, concat('batch_', CAST(pay_date AS VARCHAR(10)), '.csv') AS source_file,
    employee_id, pay_date, CAST(year(pay_date) AS INT) AS pay_year, pay_code, categorie_paie,
    CASE WHEN categorie_paie = 'Gains' THEN CASE WHEN l_returnflag = 'R' THEN -(base // 10) ELSE base END
         ELSE CASE WHEN l_returnflag = 'R' THEN base // 20 ELSE -(base // 5) END END AS amount_cents,
    CASE WHEN categorie_paie IN ('Assurances','Deductions_legales') THEN (base*tx) // 100 ELSE CAST(0 AS BIGINT) END AS employer_cents,
    concat('0-', lpad(CAST(l_suppkey AS VARCHAR(10)), 3, '0'), '-', substr(p_brand, 7), '-000') AS budget_post
  FROM b)"""

CTE['employees'] = """\
employees AS (
  SELECT c_custkey AS employee_id, concat(' ', lpad(CAST(c_custkey AS VARCHAR(10)), 6, '0'), ' ') AS matricule_raw,
    CAST(c_custkey AS VARCHAR(10)) AS matricule_norm,
    CASE WHEN c_custkey % 23 = 0 THEN upper(nm) ELSE nm END AS nom_complet,
    CASE WHEN c_acctbal < 0 THEN 'inactif' ELSE 'actif' END AS statut,
    CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 17 = 1 THEN ' ' ELSE c_mktsegment END AS categorie_emploi,
    n_name AS titre_emploi
  FROM (SELECT *, concat('Client', CAST(c_custkey AS VARCHAR(10)), ', ',
          CASE c_custkey % 7 WHEN 0 THEN 'Élodie' WHEN 1 THEN 'Noël' ELSE 'Jean' END) AS nm FROM customer) c
  JOIN nation ON c_nationkey = n_nationkey)"""

CTE['periods'] = """\
periods AS (
  SELECT pay_date, CAST(dense_rank() OVER (PARTITION BY year(pay_date) ORDER BY pay_date) AS INT) AS period_seq_in_year,
    CASE WHEN year(pay_date) <= 1996 THEN 'fermée' ELSE 'ouverte' END AS status
  FROM (SELECT DISTINCT pay_date FROM ledger) d)"""

CTE['batches'] = """\
batches AS (
  SELECT CAST(dense_rank() OVER (ORDER BY pay_date) AS INT) AS batch_id, pay_date,
    concat('batch_', CAST(pay_date AS VARCHAR(10)), '.csv') AS source_file,
    CASE WHEN month(pay_date) = 6 AND day(pay_date) = 15 THEN 'failed' ELSE 'completed' END AS status
  FROM (SELECT DISTINCT pay_date FROM ledger) d)"""

CTE['codes'] = """\
codes AS (
  SELECT * FROM (VALUES ('101','Salaire','Gains'), ('105','Heures supp','Gains'), ('106_AJUST','Prime','Gains'),
    ('450','RRQ','Deductions_legales'), ('520','Cotisation','Syndicats'), ('701','Assurance','Assurances'))
    AS v(pay_code, label, categorie))"""

CTE['sign_policies'] = """\
sign_policies AS (
  SELECT * FROM (VALUES ('520', -1, 1), ('701', -1, 1), ('450', 1, 1)) AS v(pay_code, employee_sign, employer_sign))"""

CTE['raw_lines'] = """\
raw_lines AS (
  SELECT source_row_no, txt AS montant_raw,
    CASE h % 4 WHEN 0 THEN iso
      WHEN 1 THEN concat(substr(iso,9,2), '/', substr(iso,6,2), '/', substr(iso,1,4))
      WHEN 2 THEN concat(substr(iso,1,4), '-', substr(iso,9,2), '-', substr(iso,6,2))
      ELSE CAST(ser AS VARCHAR(10)) END AS date_raw, pay_date
  FROM (SELECT source_row_no, h, pay_date, CAST(pay_date AS VARCHAR(10)) AS iso, date_diff('day', date'1899-12-30', pay_date) AS ser,
      CASE WHEN h % 50 = 4 THEN 'n/a' WHEN h % 5 = 0 THEN concat(d, ',', f)
        WHEN h % 5 = 1 THEN concat(d, ',', f, ' $') WHEN h % 5 = 2 THEN concat('(', d, ',', f, ')')
        WHEN h % 5 = 3 THEN concat('1.', lpad(d, 3, '0'), ',', f) ELSE concat('-', d, '.', f, ' CAD') END AS txt
    FROM (SELECT *, source_row_no % 1009 AS h, CAST((abs(amount_cents) // 100) % 1000 AS VARCHAR(20)) AS d,
            lpad(CAST(abs(amount_cents) % 100 AS VARCHAR(2)), 2, '0') AS f FROM ledger) x) y)"""

CTE['stg_lines'] = """\
stg_lines AS (
  SELECT CAST(1 AS INT) AS batch_id, source_file, source_row_no,
    CASE WHEN source_row_no % 101 = 0 THEN employee_id + 1000000 ELSE employee_id END AS employee_id,
    CASE WHEN source_row_no % 211 = 0 THEN NULL ELSE pay_date END AS pay_date,
    CASE WHEN source_row_no % 307 = 0 THEN '' ELSE pay_code END AS pay_code, categorie_paie,
    CASE WHEN source_row_no % 97 = 0 THEN CAST(0 AS BIGINT) ELSE amount_cents END AS amount_cents,
    CASE WHEN source_row_no % 89 = 0 THEN -employer_cents - 1 ELSE employer_cents END AS employer_cents, budget_post
  FROM ledger
  UNION ALL
  SELECT CAST(2 AS INT), source_file, source_row_no, employee_id, pay_date, pay_code, categorie_paie, amount_cents,
    employer_cents, budget_post FROM ledger WHERE source_row_no % 61 = 0)"""



def _closure(names):
    need = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack.extend(DEPS[n])
    return [n for n in ORDER if n in need]


def uses(sql: str) -> list[str]:
    """Fixture views referenced by a query text (word match)."""
    return [n for n in ORDER if re.search(r"\b" + n + r"\b", sql)]


def with_fixtures(sql: str, extra_ctes: str = "") -> str:
    """Prefix ``sql`` with the fixture CTEs it references.

    ``extra_ctes`` (``name AS (...), ...``) is appended after the fixtures and may
    reference them; ``sql`` must be a bare SELECT.
    """
    names = _closure(uses(sql + " " + extra_ctes))
    parts = [CTE[n] for n in names]
    if extra_ctes:
        parts.append(extra_ctes)
    if not parts:
        return sql
    recursive = "RECURSIVE " if "FROM steps s WHERE" in extra_ctes else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + sql
