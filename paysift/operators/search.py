"""Search, pagination and lookups.

Filters are plain predicates, so Catalyst pushes them into the Parquet scan
(a pay-date filter prunes ``pay_year`` partitions of a stored ledger). Pages
use a total order with a unique tie-break, so ``limit`` + ``offset`` are
deterministic; the top-n is a TakeOrdered, never a full sort to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.functions.names import norm_text

from .kpi import dollars


def _ledger_filter(tx: DataFrame, emp: DataFrame, pay_date=None, matricule: str = "", categorie: str = ""):
    j = tx.join(emp.select("employee_id", "matricule_norm", "nom_complet"), "employee_id")
    if pay_date:
        j = j.filter(F.col("pay_date") == F.lit(pay_date).cast("date"))
    if matricule:
        j = j.filter(F.col("matricule_norm") == matricule)
    if categorie:
        j = j.filter(F.col("pay_code").ilike(f"%{categorie}%"))
    return j


def ledger_page(tx: DataFrame, emp: DataFrame, pay_date=None, matricule: str = "", categorie: str = "",
                limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of ledger lines, newest first; ``limit`` rows as the caller asks."""
    j = _ledger_filter(tx, emp, pay_date, matricule, categorie)
    page = j.orderBy(F.desc("pay_date"), "matricule_norm", "source_row_no") \
        .offset(max(0, offset)).limit(limit)
    return page.select("matricule_norm", F.col("nom_complet").alias("nom"), F.col("pay_date").alias("date_paie"),
                       F.col("pay_code").alias("categorie"), dollars("amount_cents").alias("montant"), "source_row_no")


#: Order of seek pages: unique, as a (file, row) is one line.
SEEK_ORDER = ("pay_date", "matricule_norm", "source_row_no", "source_file")


def ledger_page_after(tx: DataFrame, emp: DataFrame, after=None, limit: int = 50, per_date: DataFrame | None = None,
                      matricule: str = "", categorie: str = "") -> DataFrame:
    """I1 by cursor: the ``limit`` lines that follow the line ``after``, newest date first.

    ``after`` is the last row of the page before (its ``SEEK_ORDER`` values); None is the first
    page. The cursor's date is a plain filter that prunes and is pushed down, so no page reads
    what earlier pages have shown, unlike an offset, which sorts it again. With
    ``per_date`` (pay_date, n: lines per date, e.g. from a stored KPI) and no other filter the page is
    bounded from below too: only the dates that fill it are read. Null dates come last, null numbers first."""
    j = tx
    if after is not None:
        day = F.lit(after[0]).cast("date")
        j = j.filter(F.col("pay_date").isNull() if after[0] is None else (F.col("pay_date") <= day) | F.col("pay_date").isNull())
        if "pay_year" in tx.columns and after[0] is not None:
            j = j.filter((F.col("pay_year") <= F.year(day)) | F.col("pay_year").isNull())
    if per_date is not None and not (matricule or categorie):
        lowest = _page_end(per_date, after, limit)
        if lowest is not None:
            j = j.filter(F.col("pay_date") >= F.lit(lowest))
            if "pay_year" in tx.columns:
                j = j.filter(F.col("pay_year") >= lowest.year)
    j = _ledger_filter(j, emp, None, matricule, categorie)
    if after is not None:
        j = j.filter(_follows(after))
    page = j.orderBy(F.desc_nulls_last("pay_date"), *[F.asc_nulls_first(c) for c in SEEK_ORDER[1:]]).limit(limit)
    return page.select("matricule_norm", F.col("nom_complet").alias("nom"), "pay_date", F.col("pay_code").alias("categorie"),
                       dollars("amount_cents").alias("montant"), "source_row_no", "source_file")


def _follows(after) -> Column:
    """Whether a line comes after the cursor in SEEK_ORDER."""
    later = F.lit(False)
    for name, value in reversed(list(zip(SEEK_ORDER, after))):
        c = F.col(name)
        if name == "pay_date":
            beyond = c.isNull() | (c < F.lit(value).cast("date")) if value is not None else F.lit(False)
        else:
            beyond = c.isNotNull() if value is None else c > F.lit(value)
        equal = c.isNull() if value is None else c == (F.lit(value).cast("date") if name == "pay_date" else F.lit(value))
        later = F.coalesce(beyond, F.lit(False)) | (F.coalesce(equal, F.lit(False)) & later)
    return later


def _page_end(per_date: DataFrame, after, limit: int):
    """Earliest date a page can reach: the dates behind the cursor's hold ``limit`` lines. None: no bound."""
    days = per_date.filter("pay_date IS NOT NULL")
    if after is not None:
        if after[0] is None:
            return None
        days = days.filter(F.col("pay_date") < F.lit(after[0]).cast("date"))
    held = 0
    for r in days.orderBy(F.desc("pay_date")).limit(limit).collect():  # every date has a line: limit dates are enough
        held += r["n"]
        if held >= limit:
            return r["pay_date"]
    return None


def cursor_of(page: DataFrame):
    """Cursor behind a page: the SEEK_ORDER values of its last row, None if it is empty."""
    last = page.orderBy(F.asc_nulls_first("pay_date"), *[F.desc_nulls_last(c) for c in SEEK_ORDER[1:]]).limit(1).collect()
    return tuple(last[0][c] for c in SEEK_ORDER) if last else None


def ledger_count(tx: DataFrame, emp: DataFrame, **filters) -> DataFrame:
    """Total lines matching the page filters."""
    return _ledger_filter(tx, emp, **filters).agg(F.count(F.lit(1)).alias("total"))


def search_lines(lines: DataFrame, date_from=None, date_to=None, employee: str = "", code: str = "",
                 post: str = "") -> DataFrame:
    """Lines with up to four optional filters (date range, employee, code, post)."""
    out = lines
    if date_from:
        out = out.filter(F.col("date_paie") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.filter(F.col("date_paie") <= F.lit(date_to).cast("date"))
    if employee:
        out = out.filter(F.col("matricule") == employee)
    if code:
        out = out.filter(F.col("code_paie").ilike(f"%{code}%"))
    if post:
        out = out.filter(F.col("poste_budgetaire").ilike(f"{post}%"))
    return out


def search_employees(emp: DataFrame, tx: DataFrame, q: str, status: str | None = None) -> DataFrame:
    """accent/case-insensitive name or number search with the last pay date."""
    needle = norm_text(F.lit(q))
    e = emp.filter(norm_text(F.col("nom_complet")).contains(needle) | F.col("matricule_norm").contains(F.lit(q)))
    if status:
        e = e.filter(F.col("statut") == status)
    last = tx.groupBy("employee_id").agg(F.max("pay_date").alias("derniere_paie"))
    return e.join(last, "employee_id", "left").select("employee_id", "matricule_norm", "nom_complet", "statut",
                                                      "derniere_paie")


def list_employees(emp: DataFrame, status: str | None = None, text: str = "", categorie: str | None = None,
                   titre: str | None = None) -> DataFrame:
    """I4: all employees by status, text, category and title, ordered."""
    e = emp
    if status:
        e = e.filter(F.col("statut") == status)
    if text:
        e = e.filter(norm_text(F.col("nom_complet")).contains(norm_text(F.lit(text))))
    if categorie:
        e = e.filter(F.col("categorie_emploi") == categorie)
    if titre:
        e = e.filter(F.col("titre_emploi") == titre)
    return e.orderBy("nom_complet", "employee_id")


def employee_detail(tx: DataFrame, emp: DataFrame, employee_id, n: int = 10) -> DataFrame:
    """One employee's last ``n`` pay dates with net and line count."""
    e = F.lit(employee_id) if not hasattr(employee_id, "alias") else employee_id
    per = tx.filter(F.col("employee_id") == e).groupBy("employee_id", "pay_date").agg(
        F.sum("amount_cents").cast("long").alias("_n"), F.count(F.lit(1)).alias("lignes"))
    top = per.orderBy(F.desc("pay_date")).limit(n)
    return top.join(emp.select("employee_id", "matricule_norm", "nom_complet", "statut"), "employee_id", "left") \
        .select("employee_id", "matricule_norm", "nom_complet", "statut", "pay_date", dollars("_n").alias("net"),
                "lignes")


def latest_pay_date(tx: DataFrame, fallback: DataFrame) -> DataFrame:
    """Latest ledger pay date, else the latest date of the fallback source."""
    a = tx.agg(F.max("pay_date").alias("_a"))
    b = fallback.agg(F.max("pay_date").alias("_b"))
    return a.crossJoin(b).select(F.coalesce("_a", "_b").alias("pay_date"),
                                 F.when(F.col("_a").isNotNull(), F.lit("ledger")).otherwise(F.lit("fallback"))
                                 .alias("source"))


def pay_dates(tx: DataFrame, batches: DataFrame) -> DataFrame:
    """Every pay date with its file and batch."""
    d = tx.select("pay_date", "source_file").distinct()
    return d.join(batches.select("pay_date", "batch_id", "status"), "pay_date", "left")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """I8: distinct non-null values of a column for filters."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct()
