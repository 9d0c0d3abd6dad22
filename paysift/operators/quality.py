"""Validation, reconciliation and data-quality checks.

Every check is a conditional aggregate or an anti/semi join; results are small
tables of (check, value) or flagged rows. No check collects data to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kpi import DEDUCTION_CATEGORIES, dollars

GAINS = "Gains"

# Validation error codes.
ERR_DATE, ERR_MAT, ERR_CODE, ERR_AMOUNT, ERR_EMPLOYER = (
    "DATE_PAIE_MANQUANTE", "MATRICULE_MANQUANT", "CODE_PAIE_MANQUANT", "MONTANT_MANQUANT",
    "PART_EMPLOYEUR_NEGATIVE")
# Identity-test tolerance (0.01 %) and period statuses.
IDENTITY_TOLERANCE = 0.0001
PERIOD_STATUSES = ("ouverte", "fermée", "archivée")
OPEN_STATUS = "ouverte"


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def _faults(date_col="pay_date", mat_col="employee_id", code_col="pay_code",
            amount_col="amount_cents", employer_col="employer_cents") -> dict[str, Column]:
    """Condition of each error code; none is ever null."""
    return {ERR_DATE: F.col(date_col).isNull(), ERR_MAT: _blank(F.col(mat_col)), ERR_CODE: _blank(F.col(code_col)),
            ERR_AMOUNT: F.col(amount_col).isNull(), ERR_EMPLOYER: F.coalesce(F.col(employer_col), F.lit(0)) < 0}


def validation_errors(date_col="pay_date", mat_col="employee_id", code_col="pay_code",
                      amount_col="amount_cents", employer_col="employer_cents") -> Column:
    checks = [F.when(wrong, F.lit(code)) for code, wrong in _faults(date_col, mat_col, code_col, amount_col, employer_col).items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate_lines(df: DataFrame, **cols) -> DataFrame:
    """Array of error codes per line and ``is_valid``, which needs no array where only it is read."""
    return df.withColumns({"validation_errors": validation_errors(**cols),
                           "is_valid": ~reduce(lambda a, b: a | b, _faults(**cols).values())})


def issue_stats(staged: DataFrame) -> DataFrame:
    """Lines per issue code (explode of the error arrays)."""
    return staged.select(F.explode("validation_errors").alias("issue")).groupBy("issue").agg(
        F.count(F.lit(1)).alias("n_lines"))


def stage_summary(staged: DataFrame) -> DataFrame:
    """Total, clean and with-issue counts."""
    return staged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_valid")).alias("clean"),
                      F.count_if(~F.col("is_valid")).alias("with_issues"))


def commit_split(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: (clean rows, rows with issues)."""
    return staged.filter(F.col("is_valid")), staged.filter(~F.col("is_valid"))


def alert_log(staged: DataFrame, run_id_col: str = "batch_id", row_col: str = "source_row_no") -> DataFrame:
    """One alert per (run, row, issue); no cap."""
    return staged.select(run_id_col, row_col, F.explode("validation_errors").alias("alert_type"))


def quality_suite(fact: DataFrame, kpi_month: DataFrame) -> DataFrame:
    """Informative quality tests, unpivoted to (test, n, status).

    ``net_identity`` counts the months whose stored KPI net (F11) is not the sum of
    gains and deductions of the fact's lines: a KPI that is out of date, a line of
    no known category, or a month on one side only. The other tests count lines."""
    known = F.col("categorie_paie").isin(GAINS, *DEDUCTION_CATEGORIES)
    per_month = fact.filter(F.col("pay_date").isNotNull() & known).groupBy(F.date_format("pay_date", "yyyy-MM").alias("mois_paie")).agg(
        F.sum("amount_cents").alias("_c"))
    stored = kpi_month.select("mois_paie", F.round(F.col("net_a_payer") * 100).cast("long").alias("_k"))
    gap = F.col("_c").isNull() | F.col("_k").isNull() | (F.abs(F.col("_c") - F.col("_k")) > 1)
    net_gaps = per_month.join(stored, "mois_paie", "full_outer").agg(F.count_if(gap).alias("n"))
    lines = fact.agg(
        F.count_if((F.col("categorie_paie") == GAINS) & (F.col("amount_cents") < 0)).alias("neg_gains"),
        F.count_if(F.col("categorie_paie").isin(*DEDUCTION_CATEGORIES) & (F.col("amount_cents") > 0)).alias("pos_ded"),
        F.count_if(F.col("employer_cents") < 0).alias("neg_employer"))
    both = net_gaps.crossJoin(lines)
    out = both.select(F.expr(
        "stack(4, 'net_identity', n, 'negative_gains', neg_gains, 'positive_deductions', pos_ded, "
        "'negative_employer_share', neg_employer) AS (test, n)"))
    return out.withColumn("status", F.when(F.col("n") == 0, F.lit("OK")).otherwise(F.lit("WARNING")))


def kpi_identity_tests(star: DataFrame) -> DataFrame:
    """Identity tests on the star KPI (cents arithmetic, 0.01 % tolerance)."""
    def c(x):
        return F.round(F.col(x) * 100).cast("long")
    net_gap = c("net_a_payer") - (c("gains_brut") - c("ajustements_gains") + c("deductions_net"))
    cash_gap = c("cash_out_total") - (c("gains_brut") - c("ajustements_gains") + c("part_employeur"))
    ded_gap = c("deductions_net") - (-c("deductions_brutes") + c("remboursements"))
    net_pct = F.abs(net_gap.cast("double") / F.nullif(c("gains_brut"), F.lit(0)))
    cash_pct = F.abs(cash_gap.cast("double") / F.nullif(c("gains_brut") + c("part_employeur"), F.lit(0)))
    return star.select(
        "date_paie", dollars(F.abs(net_gap)).alias("ecart_net"), F.round(net_pct, 6).alias("ecart_net_pct"),
        dollars(F.abs(cash_gap)).alias("ecart_cash_out"), F.round(cash_pct, 6).alias("ecart_cash_out_pct"),
        dollars(F.abs(ded_gap)).alias("ecart_deductions"),
        F.when(net_pct > IDENTITY_TOLERANCE, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("test_net_status"),
        F.when(cash_pct > IDENTITY_TOLERANCE, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("test_cash_out_status"))


def reconcile(a: DataFrame, b: DataFrame, key: str, measure_a: str, measure_b: str,
              tolerance_cents: int = 0) -> DataFrame:
    """Detail vs summary per key by FULL OUTER JOIN (NULL-safe key, missing side = gap)."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    va, vb = F.col(f"a.{measure_a}"), F.col(f"b.{measure_b}")
    gap = F.coalesce(va, F.lit(0)) - F.coalesce(vb, F.lit(0))
    return j.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), va.alias("detail"),
                    vb.alias("summary"), gap.alias("gap"),
                    ((F.abs(gap) <= tolerance_cents) & va.isNotNull() & vb.isNotNull()).alias("ok"))


def compare_amounts(old: DataFrame, new: DataFrame, key: str = "pay_date") -> DataFrame:
    """Amounts per date old vs new (FULL OUTER), gap and % (basis points, half-up)."""
    o = old.groupBy(key).agg(F.sum("amount_cents").cast("long").alias("old_cents"))
    n = new.groupBy(key).agg(F.sum("amount_cents").cast("long").alias("new_cents"))
    j = o.join(n, key, "full_outer")
    gap = F.coalesce("new_cents", F.lit(0)) - F.coalesce("old_cents", F.lit(0))
    return j.select(key, "old_cents", "new_cents", gap.alias("gap_cents"),
                    F.when(F.col("old_cents") != 0,
                           F.round(gap.cast("double") * 100.0 / F.col("old_cents"), 6)).alias("gap_pct"))


def compare_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct employees old vs new: cross join of two one-row aggregates."""
    o = old.agg(F.countDistinct("employee_id").alias("old_n"))
    n = new.agg(F.countDistinct("employee_id").alias("new_n"))
    return o.crossJoin(n).select("old_n", "new_n", (F.col("new_n") - F.col("old_n")).alias("diff"),
                                 F.round((F.col("new_n") - F.col("old_n")) * 100.0 / F.col("old_n"), 6)
                                 .alias("diff_pct"))


def ledger_checks(src: DataFrame, tx: DataFrame) -> DataFrame:
    """Migration checks as (check, value) rows from two one-pass aggregates."""
    s = src.agg(F.count(F.lit(1)).alias("src_rows"), F.sum("amount_cents").cast("long").alias("src_cents"))
    zero, nonzero = F.col("amount_cents") == 0, F.col("amount_cents") != 0
    per = tx.groupBy("pay_year", "employee_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_cents").cast("long").alias("cents"), F.max(nonzero).alias("nonzero"),
        F.count_if(zero).alias("zeros"), F.count_if(F.col("pay_year") != F.year("pay_date")).alias("mismatch"))
    t = per.agg(F.sum("n").alias("tx_rows"), F.sum("cents").cast("long").alias("tx_cents"),
                F.countDistinct("employee_id").alias("tx_employees"),
                F.countDistinct(F.when(F.col("nonzero"), F.col("employee_id"))).alias("tx_employees_nonzero"),
                F.sum("zeros").alias("tx_zero_amounts"), F.sum("mismatch").alias("tx_year_mismatch"))
    both = s.crossJoin(t)
    names = ["src_rows", "src_cents", "tx_rows", "tx_cents", "tx_employees", "tx_employees_nonzero",
             "tx_zero_amounts", "tx_year_mismatch"]
    stack = "stack({}, {}) AS (check, value)".format(
        len(names), ", ".join(f"'{n}', CAST({n} AS BIGINT)" for n in names))
    totals = both.select(F.expr(stack))
    parts = per.groupBy(F.concat(F.lit("partition_"), F.col("pay_year").cast("string")).alias("check")).agg(
        F.sum("n").alias("value"))
    return totals.unionByName(parts)


def orphans(lines: DataFrame, emp: DataFrame, key: str = "employee_id") -> DataFrame:
    """Lines whose employee is unknown (left anti join)."""
    return lines.join(emp.select(key), key, "left_anti")


def orphan_employees(emp: DataFrame, tx: DataFrame, key: str = "employee_id") -> DataFrame:
    """Employees without any transaction (NOT IN with a NULL guard = anti join)."""
    return emp.join(tx.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def drop_orphan_employees(emp: DataFrame, tx: DataFrame, key: str = "employee_id") -> DataFrame:
    """Keep only employees with transactions (left semi join)."""
    return emp.join(tx.select(key), key, "left_semi")


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys appearing more than once."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def view_checks(views: dict[str, DataFrame]) -> DataFrame:
    """Per view: rows, NULL dates, NULL combined amounts, employees without a name."""
    parts = []
    for name, v in views.items():
        parts.append(v.agg(
            F.lit(name).alias("view"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("date_paie").isNull()).alias("null_dates"),
            F.count_if(F.col("montant_combine").isNull()).alias("null_amounts"),
            F.count_if(_blank(F.col("nom_employe"))).alias("no_name")))
    return reduce(DataFrame.unionByName, parts)


def overlaps(hist: DataFrame, key: str = "employee_id", start: str = "date_debut",
             end: str = "date_fin", tie: str | None = None) -> DataFrame:
    """Intervals that start before the running max end of earlier intervals.

    The window is partitioned by employee over interval rows (no self join)."""
    order = [start, end] + ([tie] if tie else [])
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_prev_end", F.max(end).over(w)).filter(
        F.col("_prev_end").isNotNull() & (F.col(start) <= F.col("_prev_end"))).drop("_prev_end")


def date_consistency(periods: DataFrame, tx: DataFrame) -> DataFrame:
    """Period parts vs date, and transaction year vs its period date."""
    bad_parts = periods.filter(
        (F.col("pay_day") != F.dayofmonth("pay_date")) | (F.col("pay_month") != F.month("pay_date"))
        | (F.col("pay_year") != F.year("pay_date"))).agg(F.count(F.lit(1)).alias("value"))
    j = tx.join(periods.select("pay_date", F.col("pay_year").alias("_py")), "pay_date", "inner")
    bad_tx = j.filter(F.col("pay_year") != F.col("_py")).agg(F.count(F.lit(1)).alias("value"))
    return bad_parts.select(F.lit("period_parts").alias("check"), "value").unionByName(
        bad_tx.select(F.lit("tx_vs_period").alias("check"), "value"))


def domain_checks(lines: DataFrame, periods: DataFrame) -> DataFrame:
    """Rule violations counted per rule."""
    d = lines.agg(
        F.count_if(~F.dayofmonth("pay_date").between(1, 31)).alias("day_range"),
        F.count_if(~F.month("pay_date").between(1, 12)).alias("month_range"),
        F.count_if(F.col("employer_cents") < 0).alias("employer_negative"),
        F.count_if(F.col("amount_cents") == 0).alias("amount_zero"))
    p = periods.agg(F.count_if(~F.col("period_seq_in_year").between(1, 53)).alias("seq_range"),
                    F.count_if(~F.col("status").isin(*PERIOD_STATUSES)).alias("status_domain"))
    names = ["day_range", "month_range", "employer_negative", "amount_zero", "seq_range", "status_domain"]
    stack = "stack({}, {}) AS (rule, n_violations)".format(
        len(names), ", ".join(f"'{n}', CAST({n} AS BIGINT)" for n in names))
    return d.crossJoin(p).select(F.expr(stack))


def gate_open(lines: DataFrame, periods: DataFrame) -> DataFrame:
    """Tag each line 'ok' (open period) or 'refused' (closed / unknown period)."""
    p = periods.select("pay_date", "status")
    return lines.join(p, "pay_date", "left").withColumn(
        "gate", F.when(F.col("status") == OPEN_STATUS, F.lit("ok")).otherwise(F.lit("refused")))


def join_coverage(tx: DataFrame, stg: DataFrame, keys: list[str]) -> DataFrame:
    """Share of ledger lines that find their staging line on (file, row)."""
    s = stg.select(*keys).distinct().withColumn("_hit", F.lit(1))
    j = tx.select(*keys).join(s, keys, "left")
    return j.agg(F.count(F.lit(1)).alias("n_tx"), F.count("_hit").alias("n_matched"),
                 F.round(F.count("_hit") * 100.0 / F.count(F.lit(1)), 6).alias("coverage_pct"))


def diagnose_missing(ipm: DataFrame, emp: DataFrame, tx: DataFrame, keys: list[str]) -> DataFrame:
    """Why import lines are not in the ledger: unknown employee / no date / zero / already done."""
    known = ipm.join(emp.select("employee_id").withColumn("_known", F.lit(True)), "employee_id", "left")
    done = tx.select(*keys).distinct().withColumn("_done", F.lit(True))
    j = known.join(done, keys, "left")
    reason = (F.when(F.col("_known").isNull(), F.lit("no_employee"))
              .when(F.col("pay_date").isNull(), F.lit("null_date"))
              .when(F.col("amount_cents") == 0, F.lit("zero_amount"))
              .when(F.col("_done"), F.lit("already_done"))
              .otherwise(F.lit("missing")))
    return j.groupBy(reason.alias("diagnosis")).agg(F.count(F.lit(1)).alias("n_lines"))


def preview(lines: DataFrame) -> DataFrame:
    """Per pay date: brut, deductions, net, lines, employees (no write)."""
    a = F.col("amount_cents")
    agg = lines.groupBy("pay_date").agg(
        F.sum(F.when(a > 0, a).otherwise(0)).cast("long").alias("_b"),
        F.sum(F.when(a < 0, a).otherwise(0)).cast("long").alias("_d"),
        F.sum(a).cast("long").alias("_n"), F.count(F.lit(1)).alias("nb_lignes"),
        F.countDistinct("employee_id").alias("nb_employes"))
    return agg.select("pay_date", dollars("_b").alias("brut"), dollars("_d").alias("deductions"),
                      dollars("_n").alias("net"), "nb_lignes", "nb_employes")


def preview_totals(lines: DataFrame) -> DataFrame:
    """Totals of the whole import: lines, invalid dates, brut, deductions, net, employees, pay dates."""
    a = F.col("amount_cents")
    per = lines.groupBy("pay_date", "employee_id").agg(
        F.sum(F.when(a > 0, a).otherwise(0)).cast("long").alias("_b"), F.sum(F.when(a < 0, a).otherwise(0)).cast("long").alias("_d"),
        F.sum(a).cast("long").alias("_n"), F.count(F.lit(1)).alias("_c"))
    t = per.agg(F.sum("_c").alias("nb_lignes"), F.sum(F.when(F.col("pay_date").isNull(), F.col("_c")).otherwise(0)).alias("dates_invalides"),
                F.sum("_b").alias("_b"), F.sum("_d").alias("_d"), F.sum("_n").alias("_n"),
                F.countDistinct("employee_id").alias("nb_employes"), F.countDistinct("pay_date").alias("nb_dates"))
    return t.select("nb_lignes", "dates_invalides", dollars("_b").alias("brut"), dollars("_d").alias("deductions"),
                    dollars("_n").alias("net"), "nb_employes", "nb_dates")


def sample_rows(lines: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows for a screen (50 staged lines, 10 import lines)."""
    return lines.orderBy(*order).limit(n)


def stage_fields(raw: DataFrame, specs: dict, id_col: str) -> DataFrame:
    """Raw and parsed value side by side per mapped field, with the row's issues.

    ``specs`` maps a field name to ``(raw column, parser)`` where the parser is a
    Column builder; a parsed NULL or blank is an issue "<field>: valeur vide".
    Output: id, one struct<raw, parsed> per field, ``issues`` array, ``is_clean``."""
    fields, checks = [], []
    for name, (src, parser) in specs.items():
        parsed = parser(F.col(f"`{src}`"))
        fields.append(F.struct(F.col(f"`{src}`").cast("string").alias("raw"),
                               parsed.cast("string").alias("parsed")).alias(name))
        checks.append(F.when(parsed.isNull() | (F.trim(parsed.cast("string")) == ""),
                             F.lit(f"{name}: valeur vide")))
    issues = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return raw.select(F.col(f"`{id_col}`").alias("row_id"), *fields, issues.alias("issues")) \
        .withColumn("is_clean", F.size("issues") == 0)


def stage_field_stats(staged: DataFrame) -> DataFrame:
    """Total, clean and with-issue rows, and issue counts per field (one row per field)."""
    kinds = staged.groupBy("issues", "is_clean").agg(F.count(F.lit(1)).alias("_n"))  # rows by their set of issues: one reading of the lines
    every, n = Window.partitionBy(F.lit(1)), F.col("_n")  # over the sets, which the number of fields bounds
    totals = kinds.select("issues", "_n", F.sum(n).over(every).alias("total_rows"),
                          F.sum(F.when(F.col("is_clean"), n).otherwise(0)).over(every).alias("rows_clean"),
                          F.sum(F.when(~F.col("is_clean"), n).otherwise(0)).over(every).alias("rows_with_issues"))
    names = ["total_rows", "rows_clean", "rows_with_issues"]
    return totals.select(F.explode("issues").alias("issue"), "_n", *names).select(F.split("issue", ":")[0].alias("field"), "_n", *names) \
        .groupBy("field", *names).agg(F.sum("_n").alias("n_issues")).select("field", "n_issues", *names)
