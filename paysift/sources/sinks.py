"""Writers, file checksums, snapshots and run logs.

All outputs are partitioned Parquet/CSV/JSON written by executors. Scratch
outputs of the registered queries go under the session's shared checkpoint
folder (``spark.checkpoint.dir``), never a machine-local path on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.session import checkpoint_dir, scratch


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/paysift-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once to a fresh table in the shared folder and read back: one derivation for
    several uses, whose files survive lost executors and prune by ``partition_by``."""
    path = scratch(df.sparkSession, work_dir(df.sparkSession, name))
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of equal ``cols`` brought together ahead of a partitioned write, so that files grow with the data and not with
    tasks times folders. A rebalance: small partitions are merged, and a folder with much data is written by several tasks."""
    return df.hint("rebalance", *[F.col(c) for c in cols])


def append_lines(df: DataFrame, path: str, run_id: str) -> None:
    """A5: add the lines of one import run, with lineage (run id, source file, row number).

    Lines land under (import_run_id, pay_year) partitions written with dynamic
    partition overwrite: other runs are untouched, and re-running the same run
    after a failure replaces its own partitions instead of duplicating lines."""
    (df.withColumn("import_run_id", F.lit(run_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("import_run_id", "pay_year").parquet(path))


def write_ledger(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ledger stored by pay year; overwrite replaces only the years present in ``df``
    (dynamic partition overwrite), so reloading one period does not touch the others."""
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("pay_year").parquet(path))


def replace_batch(df: DataFrame, path: str) -> None:
    """Idempotent reload of one batch: dynamic overwrite of its batch partition."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report export (csv with header, json lines or parquet)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def file_checksums(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of every file in a landing folder (binaryFile source, one task per file).

    A file is one value here, so its size is bounded by Spark's 2 GB per value."""
    return spark.read.format("binaryFile").load(glob).select(
        F.col("path").alias("file_path"), F.sha2(F.col("content"), 256).alias("checksum"),
        F.col("length").alias("n_bytes"))


def new_files(current: DataFrame, seen: DataFrame, keys=("period", "checksum")) -> DataFrame:
    """Files whose (period, checksum) was not imported before; of equal new files of a period the first path."""
    keys = list(keys)
    once = current.groupBy(*keys).agg(F.min(F.struct("file_path", *[c for c in current.columns if c not in ("file_path", *keys)])).alias("_f"))
    return once.select(*keys, "_f.*").join(seen.select(*keys), keys, "left_anti").select(*current.columns)


def batch_log(staged: DataFrame) -> DataFrame:
    """Per batch: total, valid, rejected, alerts and a status from one enum."""
    agg = staged.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_valid")).alias("valid"),
        F.count_if(~F.col("is_valid")).alias("rejected"),
        F.sum(F.size("validation_errors")).cast("long").alias("alerts"))
    status = F.when(F.col("valid") == 0, F.lit("failed")).when(F.col("rejected") > 0, F.lit("completed_with_errors")) \
        .otherwise(F.lit("completed"))
    return agg.withColumn("status", status)


SNAPSHOT_SCHEMA = ("struct<cards:struct<salaire_net_total:double,masse_salariale:double,deductions:double,"
                   "net_moyen:double,nb_employes:bigint,nb_transactions:bigint>,"
                   "tables:struct<codes_top:array<struct<code:string,total:double>>>>")


def snapshot_frame(tx: DataFrame, top_n: int = 10) -> DataFrame:
    """One JSON document per pay date: cards + top codes (ranked per date on the small aggregate)."""
    from pyspark.sql import Window
    a = F.col("amount_cents")
    cards = tx.groupBy("pay_date").agg(
        (F.sum(a).cast("double") / 100.0).alias("salaire_net_total"),
        (F.sum(F.when(a > 0, a).otherwise(0)).cast("double") / 100.0).alias("masse_salariale"),
        (F.sum(F.when(a < 0, a).otherwise(0)).cast("double") / 100.0).alias("deductions"),
        F.countDistinct("employee_id").alias("nb_employes"), F.count(F.lit(1)).alias("nb_transactions"))
    cards = cards.withColumn("net_moyen", F.col("salaire_net_total") / F.col("nb_employes"))
    codes = tx.groupBy("pay_date", "pay_code").agg((F.sum(a).cast("double") / 100.0).alias("total"))
    w = Window.partitionBy("pay_date").orderBy(F.desc(F.abs("total")), "pay_code")
    top = codes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n).groupBy("pay_date").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_r"), F.col("pay_code").alias("code"), "total"))).alias("_t"))
    j = cards.join(top, "pay_date", "left")
    doc = F.struct(
        F.struct("salaire_net_total", "masse_salariale", "deductions", "net_moyen", "nb_employes",
                 "nb_transactions").alias("cards"),
        F.struct(F.transform("_t", lambda x: F.struct(x["code"].alias("code"), x["total"].alias("total")))
                 .alias("codes_top")).alias("tables"))
    return j.select("pay_date", F.to_json(doc).alias("snapshot"), F.current_timestamp().alias("computed_at"))


def snapshot_upsert(new: DataFrame, path: str) -> None:
    """Replace the snapshots of the dates present in ``new`` (dynamic partition overwrite)."""
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pay_date")
     .parquet(path))


def snapshot_get(spark: SparkSession, path: str, max_age: str | None = None) -> DataFrame:
    """Read snapshots back as typed columns (``from_json``); with ``max_age`` (e.g.
    '1 hour', the archived optimiser's expiry) only fresher snapshots are returned."""
    s = spark.read.parquet(path)
    if max_age:
        s = s.filter(F.col("computed_at") >= F.current_timestamp() - F.expr(f"INTERVAL {max_age}"))
    return s.select("pay_date", F.from_json("snapshot", SNAPSHOT_SCHEMA).alias("doc")).select(
        "pay_date", "doc.cards.*", F.size("doc.tables.codes_top").cast("long").alias("n_codes_top"))


def snapshot_list(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots: date, age stamp and document size."""
    return spark.read.parquet(path).select("pay_date", "computed_at", F.length("snapshot").alias("n_chars"))


def snapshot_or_live(spark: SparkSession, path: str, tx: DataFrame, max_age: str | None = None) -> DataFrame:
    """The snapshot of every date that has a fresh one, else the figures computed from the ledger now."""
    stored = snapshot_get(spark, path, max_age)
    rest = tx.join(stored.select("pay_date"), "pay_date", "left_anti")
    live = snapshot_frame(rest).select("pay_date", F.from_json("snapshot", SNAPSHOT_SCHEMA).alias("doc")).select(
        "pay_date", "doc.cards.*", F.size("doc.tables.codes_top").cast("long").alias("n_codes_top"))
    return stored.withColumn("source", F.lit("snapshot")).unionByName(live.withColumn("source", F.lit("live")))
