"""Star-schema and ledger load.

Upserts on plain Parquet are expressed as DataFrame algebra: insert-if-absent
is a ``left_anti`` join; SCD type 1 is a full outer join with ``coalesce(new,
old)``; first-row-wins is ``min_by(struct, row_no)`` (DISTINCT ON without a
sort of the whole table). Dimensions, fact and ledger are joined on their keys
with joins sized by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.keys import POST_DEFAULT, business_key

from .quality import validate_lines

DEDUCTION_DEFAULT = "Deductions"
GAINS = "Gains"
DEDUCTION_CATEGORIES = ("Deductions", "Deductions_legales", "Assurances", "Syndicats")


def dim_time(lines: DataFrame, old: DataFrame | None = None, date_col: str = "pay_date") -> DataFrame:
    """Time dimension of the distinct pay dates; insert-if-absent against ``old``."""
    d = lines.select(F.col(date_col).alias("date_paie")).filter(F.col("date_paie").isNotNull()).distinct()
    if old is not None:
        d = d.join(old.select("date_paie"), "date_paie", "left_anti")
    m = F.month("date_paie")
    out = d.select(
        "date_paie", F.dayofmonth("date_paie").alias("jour_paie"), m.alias("mois"),
        F.year("date_paie").alias("annee_paie"), F.quarter("date_paie").alias("trimestre"),
        F.when(m <= 6, 1).otherwise(2).alias("semestre"),
        F.date_format("date_paie", "yyyy-MM").alias("mois_paie"),
        F.year("date_paie").alias("exercice_fiscal"),
        (F.col("date_paie") == F.last_day("date_paie")).alias("is_fin_mois"),
        m.isin(3, 6, 9, 12).alias("is_fin_trimestre"), (m == 12).alias("is_fin_annee"))
    return out if old is None else old.unionByName(out)


def dim_employee(lines: DataFrame, old: DataFrame | None = None, key: str = "employee_id",
                 row_col: str = "source_row_no", attrs: tuple[str, ...] = ("nom_complet",)) -> DataFrame:
    """Employee dimension, SCD type 1: first line per number wins inside the batch,
    the new batch overwrites attributes of existing numbers."""
    first = lines.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*attrs), F.col(row_col)).alias("_a"))
    new = first.select(key, *[F.col(f"_a.{a}").alias(a) for a in attrs])
    if old is None:
        return new
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"n.{a}"), F.col(f"o.{a}")).alias(a) for a in attrs])


def dim_code(catalog: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Pay-code dimension from the catalogue (upsert: catalogue rows win)."""
    new = catalog.select("pay_code", "label", F.col("categorie").alias("categorie_paie"))
    if old is None:
        return new
    return old.join(new.select("pay_code"), "pay_code", "left_anti").unionByName(new)


def infer_codes(lines: DataFrame, dim: DataFrame) -> DataFrame:
    """Codes absent from the dimension, category from the sign of the mean amount."""
    unknown = lines.filter(F.col("pay_code").isNotNull() & (F.col("pay_code") != "")) \
        .join(dim.select("pay_code"), "pay_code", "left_anti")
    return unknown.groupBy("pay_code").agg(F.avg("amount_cents").alias("_avg")).select(
        "pay_code", F.col("pay_code").alias("label"),
        F.when(F.col("_avg") >= 0, F.lit(GAINS)).otherwise(F.lit(DEDUCTION_DEFAULT)).alias("categorie_paie"))


def dim_budget_post(lines: DataFrame) -> DataFrame:
    """E5: distinct budget posts split in four segments (fonds, fonction, compte, entite)."""
    p = lines.select(F.coalesce("budget_post", F.lit(POST_DEFAULT)).alias("poste_budgetaire")).distinct()
    parts = F.split("poste_budgetaire", "-")
    return p.select("poste_budgetaire", *[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in
                                          enumerate(["fonds", "fonction", "compte", "entite"])])


def stage(stg: DataFrame) -> DataFrame:
    """Staged lines with validation (D1) and the business key."""
    return with_key(validate_lines(stg))


def with_key(lines: DataFrame) -> DataFrame:
    """Lines with their business key."""
    return lines.withColumn("cle_metier", business_key(
        "pay_date", "employee_id", "pay_code", F.coalesce("budget_post", F.lit(POST_DEFAULT)),
        "amount_cents", "employer_cents"))


def load_fact(staged: DataFrame, codes_dim: DataFrame, fact: DataFrame | None = None, time_dim: DataFrame | None = None,
              employees_dim: DataFrame | None = None, posts_dim: DataFrame | None = None, loaded_at=None,
              dealt_by: tuple[str, ...] = ()) -> DataFrame:
    """Valid staged lines -> new fact rows with tags; conflict-free on the business key.

    Within the load, the first (batch, row) per key wins; keys
    already in ``fact`` are dropped by anti join. The category comes from the code
    dimension; the other dimensions given must know the line's date, employee and
    budget post. They are joined after the reduction to one row per key, and
    their size alone decides how (no hint: they grow with the data).
    ``loaded_at`` stamps the rows of this load. With ``dealt_by``, columns of both ``staged`` and ``fact`` that the
    key determines, the lines and the keys in ``fact`` are shuffled once, by them, and the result is left so.
    """
    codes = codes_dim.select("pay_code", F.col("categorie_paie").alias("_cat"))
    v = staged.filter("is_valid").join(F.broadcast(codes) if dealt_by else codes, "pay_code", "inner")
    line = ["batch_id", "source_row_no", "source_file", "employee_id", "pay_date", "pay_code", "_cat", "budget_post",
            "amount_cents", "employer_cents"]  # (batch, row) lead, so they are not carried twice
    if dealt_by:
        v = v.select("cle_metier", *dict.fromkeys([*dealt_by, *line]), F.lit(False).alias("_known"))
        if fact is not None:
            v = v.unionByName(fact.select("cle_metier", *dealt_by, F.lit(True).alias("_known")), allowMissingColumns=True)
        firsts = (v.repartition(*dealt_by).groupBy(*dealt_by, "cle_metier").agg(F.min(F.when(~F.col("_known"), F.struct(*line))).alias("r"), F.bool_or("_known").alias("_known"))
                  .filter(~F.col("_known")))
    else:
        firsts = v.groupBy("cle_metier").agg(F.min(F.struct(*line)).alias("r"))
    rows = firsts.select("cle_metier", "r.*").withColumn("poste_budgetaire", F.coalesce("budget_post", F.lit(POST_DEFAULT)))
    if fact is not None and not dealt_by:
        rows = rows.join(fact.select("cle_metier"), "cle_metier", "left_anti")
    for dim, key in ((time_dim.withColumnRenamed("date_paie", "pay_date") if time_dim is not None else None, "pay_date"),
                     (employees_dim, "employee_id"), (posts_dim, "poste_budgetaire")):
        if dim is not None:
            rows = rows.join(dim.select(key), key, "left_semi")
    cat = F.col("_cat")
    stamp = [] if loaded_at is None else [F.lit(loaded_at).cast("timestamp_ntz").alias("loaded_at")]
    return rows.select(
        "cle_metier", "pay_date", "employee_id", "pay_code", cat.alias("categorie_paie"),
        "poste_budgetaire", "amount_cents",
        "employer_cents", F.col("batch_id").alias("source_batch_id"), "source_file", "source_row_no",
        ((cat == GAINS) & (F.col("amount_cents") < 0)).alias("is_adjustment"),
        (cat.isin(*DEDUCTION_CATEGORIES) & (F.col("amount_cents") > 0)).alias("is_refund"),
        F.col("batch_id").alias("first_seen_batch_id"), *stamp)


def dedup_log(staged: DataFrame) -> DataFrame:
    """Valid lines whose business key was already seen (earlier batch/row)."""
    v = staged.filter("is_valid")
    first = v.groupBy("cle_metier").agg(F.min(F.struct("batch_id", "source_row_no")).alias("_f"))
    j = v.join(first, "cle_metier")
    return j.filter(F.struct("batch_id", "source_row_no") != F.col("_f")).select(
        "cle_metier", "batch_id", "source_row_no", "pay_date", "employee_id", "pay_code", "amount_cents",
        F.col("_f.batch_id").alias("first_seen_batch_id"))


def dedup_report(log: DataFrame) -> DataFrame:
    """Duplicates per batch and date, ignored amount, all codes and numbers listed.

    One aggregate over the log. The sets are combined map-side, so what reaches a
    group's task is its distinct values, which are the lists themselves."""
    mats = F.collect_set(F.col("employee_id").cast("string"))
    agg = log.groupBy("batch_id", "pay_date").agg(
        F.count(F.lit(1)).alias("nb_doublons"),
        (F.sum(F.abs("amount_cents")).cast("double") / 100.0).alias("montant_total_ignore"),
        F.array_sort(F.collect_set("pay_code")).alias("_codes"), F.array_sort(mats).alias("_mats"))

    def text(c):
        return F.when(F.size(c) > 0, F.array_join(c, ", "))

    return agg.select("batch_id", "pay_date", "nb_doublons", "montant_total_ignore",
                      F.size("_codes").cast("long").alias("nb_codes"), F.size("_mats").cast("long").alias("nb_matricules"),
                      text("_codes").alias("codes_paie_concernes"), text("_mats").alias("matricules_concernes"))


def dedup_values(log: DataFrame) -> DataFrame:
    """E8 as rows: every code and every number that the duplicates of a batch and date concern, with their count.

    The same content as the lists of ``dedup_report`` without a row that grows with a batch."""
    kinds = F.array(F.struct(F.lit("code_paie").alias("kind"), F.col("pay_code").alias("value")),
                    F.struct(F.lit("matricule").alias("kind"), F.col("employee_id").cast("string").alias("value")))
    return (log.select("batch_id", "pay_date", F.explode(kinds).alias("v")).select("batch_id", "pay_date", "v.*").filter("value IS NOT NULL")
            .groupBy("batch_id", "pay_date", "kind", "value").agg(F.count(F.lit(1)).alias("nb_doublons")))


def extract_employees(stg: DataFrame, key: str = "employee_id", row_col: str = "source_row_no") -> DataFrame:
    """One row per employee key with the attributes of its earliest source row."""
    cols = [c for c in stg.columns if c != key]
    return stg.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*cols), F.col(row_col)).alias("_r")).select(key, "_r.*")


def period_sequence(dates: DataFrame, date_col: str = "pay_date") -> DataFrame:
    """Sequence of each distinct date inside its year (rank on the distinct dates only)."""
    d = dates.select(date_col).filter(F.col(date_col).isNotNull()).distinct()
    w = Window.partitionBy(F.year(date_col)).orderBy(date_col)
    return d.select(date_col, F.dense_rank().over(w).cast("int").alias("period_seq_in_year"))


def build_ledger(stg: DataFrame, emp: DataFrame) -> DataFrame:
    """Drop zero amounts and lines without date, keep known employees, add year and
    period sequence (computed on distinct dates, joined back: a broadcast-sized table)."""
    lines = stg.filter((F.col("amount_cents") != 0) & F.col("pay_date").isNotNull())
    lines = lines.join(emp.select("employee_id"), "employee_id", "left_semi")
    seq = period_sequence(lines)
    return lines.join(F.broadcast(seq), "pay_date").withColumn("pay_year", F.year("pay_date").cast("int"))


def incremental_ledger(ipm: DataFrame, emp: DataFrame, tx: DataFrame,
                       keys=("pay_date", "source_file", "source_row_no")) -> DataFrame:
    """Import lines whose (date, file, row) is not yet in the ledger, known employees only."""
    keys = list(keys)
    new = ipm.join(tx.select(*keys), keys, "left_anti")
    return new.join(emp.select("employee_id"), "employee_id", "inner")


def ensure_periods(dates: DataFrame, old: DataFrame) -> DataFrame:
    """Add a period for every date that has none; sequence continues after the
    year's current max; status 'ouverte'."""
    missing = dates.select("pay_date").filter(F.col("pay_date").isNotNull()).distinct() \
        .join(old.select("pay_date"), "pay_date", "left_anti")
    mx = old.groupBy(F.year("pay_date").alias("_y")).agg(F.max("period_seq_in_year").alias("_max"))
    w = Window.partitionBy(F.year("pay_date")).orderBy("pay_date")
    added = missing.withColumn("_y", F.year("pay_date")).join(F.broadcast(mx), "_y", "left").select(
        "pay_date", (F.coalesce("_max", F.lit(0)) + F.row_number().over(w)).cast("int").alias("period_seq_in_year"),
        F.lit("ouverte").alias("status"))
    return old.select("pay_date", "period_seq_in_year", "status").unionByName(added)


def with_status(periods: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply status changes (pay_date, status) to the period table; unknown dates ignored,
    periods without a change keep their status."""
    ch = changes.select("pay_date", F.col("status").alias("_new"))
    return periods.join(ch, "pay_date", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def delete_period(tx: DataFrame, batches: DataFrame, emp: DataFrame, periods: DataFrame, pay_date) -> dict:
    """Remove one pay date: remaining tables and an audit row (counts, future orphans)."""
    d = pay_date if not isinstance(pay_date, str) else F.lit(pay_date).cast("date")
    keep_tx = tx.filter(F.col("pay_date") != d)
    gone_tx = tx.filter(F.col("pay_date") == d)
    future_orphans = emp.join(gone_tx.select("employee_id"), "employee_id", "left_semi") \
        .join(keep_tx.select("employee_id"), "employee_id", "left_anti")
    audit = gone_tx.agg(F.count(F.lit(1)).alias("lines_deleted"),
                        F.countDistinct("employee_id").alias("employees_touched")).crossJoin(
        batches.filter(F.col("pay_date") == d).agg(F.count(F.lit(1)).alias("batches_deleted"))).crossJoin(
        future_orphans.agg(F.count(F.lit(1)).alias("future_orphans"))).select(
        d.alias("pay_date"), "lines_deleted", "employees_touched", "batches_deleted", "future_orphans")
    return {"ledger": keep_tx, "batches": batches.filter(F.col("pay_date") != d),
            "employees": emp.join(future_orphans.select("employee_id"), "employee_id", "left_anti"),
            "periods": periods.filter(F.col("pay_date") != d), "audit": audit}
