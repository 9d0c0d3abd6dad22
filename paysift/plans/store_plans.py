"""Queries on the bucketed ledger store (A9 with D10, D18, E12): the stored side is read in place."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paysift.operators import quality as Q
from paysift.sources import fixtures as fx
from paysift.sources import ledger_store as LS
from paysift.sources.sinks import stored, work_dir

from .catalog import query
from .quality_plans import LEDGER2_CTE, STAGED_CTE, built_ledger, staged

#: Years with a partition of their own in the queries below; the calendar of the tables goes on behind them.
FIRST_YEAR, LAST_YEAR = 1992, 1996


def _store(spark, lines):
    name, path = f"ledger_{uuid.uuid4().hex}", work_dir(spark, "ledger-store")
    LS.create_store(lines, name, path, FIRST_YEAR, LAST_YEAR)
    return name, path


@query("a09_ledger_store", f"""
SELECT CASE WHEN year(pay_date) BETWEEN {FIRST_YEAR} AND {LAST_YEAR + 1} THEN CAST(year(pay_date) AS VARCHAR) ELSE 'default' END AS year_part,
  count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents
FROM stg_lines GROUP BY 1
""")
def a09_store(spark, sf):
    """Declared years, one year attached later, and the default partition for all others and for lines without date."""
    name, path = _store(spark, fx.stg_lines(spark, sf))
    LS.attach_year(spark, name, path, LAST_YEAR + 1)
    return spark.table(name).groupBy("year_part").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"))


@query("d10_stored_orphans", "SELECT * FROM stg_lines s WHERE NOT EXISTS (SELECT 1 FROM employees e WHERE e.employee_id = s.employee_id)")
def d10_stored(spark, sf):
    lines = fx.stg_lines(spark, sf)
    name, _ = _store(spark, lines)
    return Q.orphans(spark.table(name), fx.employees(spark, sf)).select(*lines.columns)


@query("d18_stored_coverage", """
SELECT count(*) AS n_tx, count(s.hit) AS n_matched, round(count(s.hit) * 100.0 / count(*), 6) AS coverage_pct
FROM ledger t LEFT JOIN (SELECT DISTINCT source_file, source_row_no, 1 AS hit FROM staged WHERE is_valid) s
  ON s.source_file = t.source_file AND s.source_row_no = t.source_row_no
""", ctes=STAGED_CTE)
def d18_stored(spark, sf):
    name, _ = _store(spark, fx.ledger(spark, sf))
    return Q.join_coverage(spark.table(f"{name}_rows"), staged(spark, sf).filter("is_valid"), LS.ROW_KEY)


@query("e12_stored_incremental", """
SELECT i.batch_id, i.source_file, i.source_row_no, i.pay_date, i.employee_id, i.amount_cents
FROM stg_lines i JOIN (SELECT employee_id AS known_id FROM employees) e ON e.known_id = i.employee_id
LEFT JOIN (SELECT DISTINCT pay_date, source_file, source_row_no, true AS done FROM ledger2) d
  ON d.pay_date = i.pay_date AND d.source_file = i.source_file AND d.source_row_no = i.source_row_no
WHERE d.done IS NULL
""", ctes=STAGED_CTE + ",\n" + LEDGER2_CTE)
def e12_stored(spark, sf):
    st = stored(staged(spark, sf), "staging")
    name, _ = _store(spark, built_ledger(spark, sf, st))
    known = st.join(fx.employees(spark, sf).select("employee_id"), "employee_id", "left_semi")
    return LS.new_lines(known, spark.table(f"{name}_rows")).select(
        "batch_id", "source_file", "source_row_no", "pay_date", "employee_id", "amount_cents")
