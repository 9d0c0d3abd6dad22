"""Canonical lines and row ordinals.

``canonical_lines`` enriches ledger lines with the pay-code catalogue (tiny,
broadcast) and the employee table (large: a shuffle join on ``employee_id``,
sized by AQE). Money stays in cents.

``with_row_no`` numbers the rows of a narrow key frame in any total order without a single-partition
window: Spark's range partitioner cuts the keys at sampled quantiles, so ranges are even whatever the
values are, the sorted keys are written once, and a table with one row per range gives the offsets.
``number_lines`` numbers the lines of files by joining them with such numbered keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.session import shuffle_partitions
from paysift.sources.sinks import stored


def _ranges(df: DataFrame, order_cols: list[str], num_partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_range`` and ``_ahead`` (sum of ``_c`` of the rows before it in its range), and the offsets by range.

    The keys are dealt by range and written to a table first, so that numbers and
    offsets come from one and the same cut, also when an executor is lost."""
    n = num_partitions or shuffle_partitions(df.sparkSession)
    cut = stored(df.repartitionByRange(n, *order_cols).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = cut.groupBy("_range").agg(F.sum("_c").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return cut.withColumn("_ahead", F.coalesce(F.sum("_c").over(inside), F.lit(0))), offsets


def with_row_no(df: DataFrame, order_cols: list[str], name: str = "row_no",
                num_partitions: int | None = None) -> DataFrame:
    """Global 1-based ordinal by ``order_cols`` (which must be unique together)."""
    cut, offsets = _ranges(df.withColumn("_c", F.lit(1)), order_cols, num_partitions)
    return (cut.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_off") + F.col("_ahead") + 1)
            .drop("_range", "_ahead", "_off", "_c"))


def number_lines(df: DataFrame, file_col: str = "source_file", order_col: str = "source_row_no",
                 line: str | None = "line_no", in_file: str | None = None, header_offset: int = 2,
                 num_partitions: int | None = None) -> DataFrame:
    """Global 1-based ordinal by (file, row) and the row number inside each file (+ header offset).

    The (file, row) keys are numbered on their own (``with_row_no``'s ranges, so
    neither a hot file nor far-off row numbers make a large group) and joined with
    the lines, which are shuffled once. Lines that share a key follow each other in any order."""
    key = ["_f1", "_f", "_o1", "_o"]  # plain equality on values that are not null; null files and rows come first
    rows = df.withColumns({"_f1": F.isnotnull(file_col), "_f": F.coalesce(F.col(file_col), F.lit("")),
                           "_o1": F.isnotnull(order_col), "_o": F.coalesce(F.col(order_col), F.lit(0))}).drop(file_col, order_col)
    cut, offsets = _ranges(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")), key, num_partitions)
    numbered = cut.join(F.broadcast(offsets), "_range").select(*key, (F.col("_off") + F.col("_ahead")).alias("_b"))
    if in_file:
        numbered = numbered.join(numbered.groupBy("_f1", "_f").agg(F.min("_b").alias("_start")), ["_f1", "_f"])
    # the join has dealt and sorted the lines by their key already
    out = rows.join(numbered, key).withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy("_b")))
    new = {file_col: F.when(F.col("_f1"), F.col("_f")), order_col: F.when(F.col("_o1"), F.col("_o"))}  # shuffled once, as the key
    if line:
        new[line] = F.col("_b") + F.col("_i")
    if in_file:
        new[in_file] = F.col("_b") + F.col("_i") - 1 - F.col("_start") + header_offset
    return out.withColumns(new).select(*df.columns, *[c for c in new if c not in (file_col, order_col)])


EMPLOYEE_ATTRS = ["matricule", "nom_employe", "categorie_emploi", "titre_emploi", "statut"]


def canonical_lines(tx: DataFrame, codes: DataFrame, emp: DataFrame | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """canonical lines (ledger + code label + employee attributes), cents kept; ``keep`` names further columns of the lines.

    With ``emp=None`` the employee attributes are left out and no join with the
    employee table happens. Catalyst cannot drop an unused LEFT JOIN (it does not
    know the employee key is unique), and at scale that join is a full shuffle
    of the ledger, so views that never read employee attributes ask for the
    employee-free lines."""
    c = F.broadcast(codes.select("pay_code", F.col("label").alias("description_code_paie")))
    out = tx.join(c, "pay_code", "left")
    attrs = []
    if emp is not None:
        e = emp.select("employee_id", F.col("matricule_norm").alias("matricule"),
                       F.col("nom_complet").alias("nom_employe"), "categorie_emploi", "titre_emploi", "statut")
        out = out.join(e, "employee_id", "left")
        attrs = EMPLOYEE_ATTRS
    return out.select("source_file", "source_row_no", F.col("pay_date").alias("date_paie"), "employee_id",
                      *attrs, "categorie_paie", F.col("pay_code").alias("code_paie"), "description_code_paie",
                      F.col("budget_post").alias("poste_budgetaire"), F.col("amount_cents").alias("montant_employe"),
                      F.col("employer_cents").alias("part_employeur"),
                      (F.col("amount_cents") + F.col("employer_cents")).alias("montant_combine"), *keep)


def flag_lines(lines: DataFrame) -> DataFrame:
    """Meta-row flag (combined amount 0), inactive flag, period strings."""
    name = F.col("nom_employe")
    return lines.select(
        "*",
        (F.col("montant_combine") == 0).alias("is_meta_row"),
        ((name == F.upper(name)) & name.rlike("[A-Za-z]")).alias("is_inactive"),
        F.date_format("date_paie", "yyyy-MM-dd").alias("pay_date_str"),
        F.date_format("date_paie", "yyyy-MM").alias("period"))
