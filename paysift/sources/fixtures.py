"""Fixture views: the driver's TPC-H-like tables re-read as a pay ledger.

Each builder is a lazy DataFrame derived from the driver tables, so the work of
every query grows with them. The same views exist as DuckDB SQL text in
``paysift.plans.fixture_sql`` for the oracle; both follow FIXTURES.md.

Scale notes
-----------
* ``ledger``: the per-order row number is a window partitioned by
  ``l_orderkey``; the following join with ``orders`` is on the same key, so
  Spark reuses that hash partitioning (one exchange for lineitem). ``part`` is
  joined on ``l_partkey``; it grows with the data, so no broadcast hint is put
  on it: the planner broadcasts only under ``autoBroadcastJoinThreshold`` and
  AQE re-plans with the real size.
* ``periods`` / ``batches``: ranks are computed on the distinct pay dates
  (a few hundred rows per decade), never on ledger rows.
* ``codes`` / ``sign_policies``: catalogues with a fixed handful of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the fixture mapping (FIXTURES.md): line number -> pay code, category.
PAY_CODE_BY_LINE = {1: "101", 2: "105", 3: "106_AJUST", 4: "450", 5: "520", 6: "701"}
PAY_CODE_OTHER = "580_REMBOURSE"
CATEGORY_GAINS_MAX_LINE = 3
CATEGORY_BY_LINE = {4: "Deductions_legales", 5: "Syndicats", 6: "Assurances"}
CATEGORY_OTHER = "Deductions"

# Pay-code catalogue (580_REMBOURSE deliberately absent) and sign policy.
CODE_ROWS = [
    ("101", "Salaire", "Gains"),
    ("105", "Heures supp", "Gains"),
    ("106_AJUST", "Prime", "Gains"),
    ("450", "RRQ", "Deductions_legales"),
    ("520", "Cotisation", "Syndicats"),
    ("701", "Assurance", "Assurances"),
]
SIGN_POLICY_ROWS = [("520", -1, 1), ("701", -1, 1), ("450", 1, 1)]
# First names of the employee fixture, by c_custkey % 7 (0, 1, other).
FIRST_NAMES = ("Élodie", "Noël", "Jean")


def _case(col, mapping: dict, other):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(other))


def _categorie(ln):
    return F.when(ln <= CATEGORY_GAINS_MAX_LINE, F.lit("Gains")).otherwise(_case(ln, CATEGORY_BY_LINE, CATEGORY_OTHER))


def ledger_lines(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    """The ledger's lines as keys and numbers, one per lineitem row; :func:`ledger_columns` makes its columns of them.

    With ``people`` (one key column ``c_custkey`` and others) each line has the columns of its employee, null
    without one. They come with the orders, of which there are fewer than lines: no line is shuffled for them."""
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 1 << 20).alias("brand"))

    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax",
        "l_returnflag",
        (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("source_row_no"))

    od = F.col("o_orderdate")
    pay_date = F.when(F.dayofmonth(od) <= 15, F.date_add(F.trunc(od, "month"), 14)) \
        .otherwise(F.last_day(od.cast("date")))
    orders = orders.select("o_orderkey", F.col("o_custkey").alias("employee_id"), pay_date.alias("pay_date"))
    own = [c for c in people.columns if c != "c_custkey"] if people is not None else []
    if people is not None:
        orders = orders.join(people, F.col("employee_id") == F.col("c_custkey"), "left").drop("c_custkey")
    ln = F.col("l_linenumber")
    gains, refund = ln <= CATEGORY_GAINS_MAX_LINE, F.col("l_returnflag") == "R"
    base = F.round(F.col("l_extendedprice") * 100).cast("long").alias("base")
    b = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "source_row_no", "employee_id", "pay_date", "l_linenumber", "l_partkey", "l_suppkey",
        base, F.round(F.col("l_tax") * 100).cast("long").alias("tx"), refund.alias("refund"), *own)
    # amounts before the join with part: its shuffle carries two numbers of cents, no prices, rates or flags
    amount = F.when(gains, F.when(F.col("refund"), -F.expr("base div 10")).otherwise(F.col("base"))) \
        .otherwise(F.when(F.col("refund"), F.expr("base div 20")).otherwise(-F.expr("base div 5")))
    employer = F.when(_categorie(ln).isin("Assurances", "Deductions_legales"), F.expr("(base * tx) div 100")).otherwise(F.lit(0).cast("long"))
    b = b.select("source_row_no", "employee_id", "pay_date", "l_linenumber", "l_partkey", "l_suppkey",
                 amount.cast("long").alias("amount_cents"), employer.cast("long").alias("employer_cents"), *own)
    return b.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")


def source_file(pay_date: str = "pay_date") -> F.Column:
    return F.concat(F.lit("batch_"), F.col(pay_date).cast("string"), F.lit(".csv"))


def ledger_columns(lines: DataFrame, *keep) -> DataFrame:
    """:func:`ledger_lines` as the ledger's columns, with the columns ``keep`` of the lines."""
    ln = F.col("l_linenumber")
    return lines.select(
        "source_row_no", source_file().alias("source_file"), "employee_id", "pay_date",
        F.year("pay_date").cast("int").alias("pay_year"),
        _case(ln, PAY_CODE_BY_LINE, PAY_CODE_OTHER).alias("pay_code"), _categorie(ln).alias("categorie_paie"),
        "amount_cents", "employer_cents",
        F.concat(F.lit("0-"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0"), F.lit("-"),
                 F.col("brand"), F.lit("-000")).alias("budget_post"), *keep)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean pay ledger, one line per lineitem row."""
    return ledger_columns(ledger_lines(spark, sf_dir))


def employee_texts(key: str, segment: str) -> dict[str, F.Column]:
    """Texts of an employee by column: every 23rd name upper-case, blank categories, accents."""
    k = F.col(key)
    first = F.when(k % 7 == 0, F.lit(FIRST_NAMES[0])).when(k % 7 == 1, F.lit(FIRST_NAMES[1])) \
        .otherwise(F.lit(FIRST_NAMES[2]))
    nm = F.concat(F.lit("Client"), k.cast("string"), F.lit(", "), first)
    return {"matricule_raw": F.concat(F.lit(" "), F.lpad(k.cast("string"), 6, "0"), F.lit(" ")),
            "nom_complet": F.when(k % 23 == 0, F.upper(nm)).otherwise(nm),
            "categorie_emploi": F.when(k % 17 == 0, F.lit(None).cast("string")).when(k % 17 == 1, F.lit(" ")).otherwise(F.col(segment))}


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee table; every 23rd name upper-case, blank categories, accents."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                                     "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k, text = F.col("c_custkey"), employee_texts("c_custkey", "c_mktsegment")
    return (c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                k.alias("employee_id"),
                text["matricule_raw"].alias("matricule_raw"),
                k.cast("string").alias("matricule_norm"),
                text["nom_complet"].alias("nom_complet"),
                F.when(F.col("c_acctbal") < 0, F.lit("inactif")).otherwise(F.lit("actif")).alias("statut"),
                text["categorie_emploi"].alias("categorie_emploi"),
                F.col("n_name").alias("titre_emploi")))


def pay_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pay dates of the ledger (small: two per month)."""
    return ledger(spark, sf_dir).select("pay_date").distinct()


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay periods with sequence in year; closed up to 1996."""
    return periods_of(pay_dates(spark, sf_dir))


def periods_of(d: DataFrame) -> DataFrame:
    """:func:`periods` of the distinct pay dates ``d``."""
    w = Window.partitionBy(F.year("pay_date")).orderBy("pay_date")
    return d.select(
        "pay_date",
        F.dense_rank().over(w).cast("int").alias("period_seq_in_year"),
        F.when(F.year("pay_date") <= 1996, F.lit("fermée")).otherwise(F.lit("ouverte")).alias("status"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import batch per pay date; mid-June batches failed.

    The rank is over the distinct dates only (hundreds of rows), so the
    single-partition window is bounded by the calendar, not by the ledger.
    """
    d = pay_dates(spark, sf_dir)
    return d.select(
        F.dense_rank().over(Window.orderBy("pay_date")).cast("int").alias("batch_id"),
        "pay_date",
        F.concat(F.lit("batch_"), F.col("pay_date").cast("string"), F.lit(".csv")).alias("source_file"),
        F.when((F.month("pay_date") == 6) & (F.dayofmonth("pay_date") == 15), F.lit("failed"))
        .otherwise(F.lit("completed")).alias("status"))


def codes(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Pay-code catalogue (fixed, six rows)."""
    return spark.createDataFrame(CODE_ROWS, "pay_code string, label string, categorie string")


def sign_policies(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Sign policy per pay code (fixed, three rows); absent codes default to +1."""
    return spark.createDataFrame(SIGN_POLICY_ROWS,
                                 "pay_code string, employee_sign int, employer_sign int")


def raw_text_columns(amount_col: str = "amount_cents", date_col: str = "pay_date",
                     row_col: str = "source_row_no", iso=None):
    """Text amount and text date of a line, in every accepted shape (FIXTURES.md raw_lines); ``iso``: the date as text, if it is there."""
    h = F.col(row_col) % 1009
    a = F.abs(F.col(amount_col))
    d = (F.expr(f"abs({amount_col}) div 100") % 1000).cast("string")
    f = F.lpad((a % 100).cast("string"), 2, "0")
    txt = (F.when(h % 50 == 4, F.lit("n/a"))
           .when(h % 5 == 0, F.concat(d, F.lit(","), f))
           .when(h % 5 == 1, F.concat(d, F.lit(","), f, F.lit(" $")))
           .when(h % 5 == 2, F.concat(F.lit("("), d, F.lit(","), f, F.lit(")")))
           .when(h % 5 == 3, F.concat(F.lit("1."), F.lpad(d, 3, "0"), F.lit(","), f))
           .otherwise(F.concat(F.lit("-"), d, F.lit("."), f, F.lit(" CAD"))))
    iso = F.col(date_col).cast("string") if iso is None else iso
    ser = F.datediff(F.col(date_col), F.lit("1899-12-30").cast("date"))
    date_raw = (F.when(h % 4 == 0, iso)
                .when(h % 4 == 1, F.concat(F.substring(iso, 9, 2), F.lit("/"), F.substring(iso, 6, 2),
                                           F.lit("/"), F.substring(iso, 1, 4)))
                .when(h % 4 == 2, F.concat(F.substring(iso, 1, 4), F.lit("-"), F.substring(iso, 9, 2),
                                           F.lit("-"), F.substring(iso, 6, 2)))
                .otherwise(ser.cast("string")))
    return txt, date_raw


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text amounts and dates in every accepted shape, 2 % unparsable amounts."""
    txt, date_raw = raw_text_columns()
    return ledger(spark, sf_dir).select("source_row_no", txt.alias("montant_raw"), date_raw.alias("date_raw"),
                                        "pay_date")


def stg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disturbed staging: unknown employees, null dates, blank codes, zero amounts,
    negative employer share, and a second batch that re-sends some lines."""
    return stg_from_ledger(ledger(spark, sf_dir))


def stg_from_ledger(lg: DataFrame) -> DataFrame:
    """One row per ledger line in batch 1, disturbed, and a second, clean one in batch 2 for the re-sent lines: the
    ledger is derived once."""
    r = F.col("source_row_no")
    batches = F.when(r % 61 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    first = F.col("batch_id") == 1

    def disturbed(every: int, value, column: str):
        return F.when(first & (r % every == 0), value).otherwise(F.col(column)).alias(column)
    return lg.withColumn("batch_id", F.explode(batches)).select(
        "batch_id", "source_file", "source_row_no",
        disturbed(101, F.col("employee_id") + 1000000, "employee_id"), disturbed(211, F.lit(None).cast("date"), "pay_date"),
        disturbed(307, F.lit(""), "pay_code"), "categorie_paie", disturbed(97, F.lit(0).cast("long"), "amount_cents"),
        disturbed(89, -F.col("employer_cents") - 1, "employer_cents"), "budget_post")


FIXTURES = {
    "ledger": ledger, "employees": employees, "periods": periods, "batches": batches,
    "codes": codes, "sign_policies": sign_policies, "raw_lines": raw_lines, "stg_lines": stg_lines,
}


def union_all(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)

