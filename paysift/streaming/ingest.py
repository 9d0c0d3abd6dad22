"""Streaming ingestion, dedup and KPI.

* M1 ``stream_ingest``: a file-source stream of pay files; each micro-batch is
  canonicalised, parsed and validated with the batch operators and written as
  lines, alerts and (with a code dimension) fact rows. All three become visible
  with one small file per epoch (``publish``) that names the attempt that wrote
  them; readers (``published``) see whole epochs only, a retried epoch that was
  published is skipped and one that was not leaves nothing visible.
* M2 ``stream_dedup``: keyed state, one entry per business key in RocksDB;
  nothing is dropped for its age and no micro-batch reads stored lines.
* M3 ``stream_kpi``: tumbling daily windows in update mode; lines of closed
  periods are refused by a stream-static join with the period table (D17).

Checkpoints and outputs live under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysift.functions.amounts import amount_to_cents
from paysift.functions.dates import WIDE_YEAR_HI, WIDE_YEAR_LO, parse_pay_date
from paysift.functions.keys import POST_DEFAULT, business_key
from paysift.functions.names import norm_matricule
from paysift.operators.quality import validate_lines
from paysift.operators.warehouse import load_fact
from paysift.sources.mapping import canonicalise_columns
from paysift.sources.payfile import file_formats, read_canonical, text_lines
from paysift.sources.sinks import stored

OPEN_STATUS = "ouverte"
#: Fact lines of one pay date and epoch that one task loads and writes.
LINES_A_FILE = 1 << 18


def stage_batch(raw: DataFrame, canonical: bool = False) -> DataFrame:
    """Canonical, typed and validated lines of one micro-batch (batch operators reused)."""
    c = raw if canonical else canonicalise_columns(raw)
    for name in ("categorie_paie", "poste_budgetaire", "part_employeur", "numero_ligne"):  # columns a file may lack
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast("string"))
    typed = c.select(
        "file_path", F.col("numero_ligne").try_cast("long").alias("source_row_no"),
        F.trim("matricule").alias("matricule"),
        parse_pay_date("date_paie", WIDE_YEAR_LO, WIDE_YEAR_HI).alias("pay_date"),
        F.trim("code_paie").alias("pay_code"), F.col("categorie_paie"), F.col("poste_budgetaire").alias("budget_post"),
        amount_to_cents("montant_employe").alias("amount_cents"),
        amount_to_cents("part_employeur").alias("employer_cents"))
    return validate_lines(typed, mat_col="matricule")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish(spark: SparkSession, out: str, epoch_id: int, attempt: str) -> None:
    """Make the rows that ``attempt`` wrote for ``epoch_id`` visible, in all tables at once.

    The name of the attempt is one file, written aside and renamed into place, so it is there or not."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = path(f"{out}/_publishing/{attempt}")
    stream = fs.create(aside, True)
    stream.write(bytearray(f'{{"epoch": {epoch_id}, "attempt": "{attempt}"}}\n', "utf-8"))
    stream.close()
    fs.mkdirs(path(f"{out}/published"))
    fs.rename(aside, path(f"{out}/published/epoch-{epoch_id}.json"))


def published(spark: SparkSession, out: str, table: str, dates: list | None = None) -> DataFrame | None:
    """Rows of ``table`` (``lines``, ``alerts`` or ``fact``) of all published epochs; None before the first.

    With ``dates`` only the folders of these pay dates of the fact are listed and read."""
    paths = [f"{out}/{table}"] if dates is None else [f"{out}/{table}/pay_date={d}" for d in dates]
    paths = [p for p in paths if _exists(spark, p)]
    if not paths or not _exists(spark, f"{out}/published"):
        return None
    marks = spark.read.schema("epoch bigint, attempt string").json(f"{out}/published")
    rows = spark.read.option("basePath", f"{out}/{table}").parquet(*paths)
    return rows.withColumn("epoch", F.col("epoch").cast("long")).join(marks, ["epoch", "attempt"], "left_semi")


def fact_lines(staged: DataFrame, epoch_id: int) -> DataFrame:
    """Lines of one epoch in the shape of the fact load (E7): employee key, batch = epoch, business key."""
    key = norm_matricule(F.col("matricule"))
    return (staged.withColumn("employee_id", key).withColumn("batch_id", F.lit(epoch_id)).withColumnRenamed("file_path", "source_file")
            .withColumn("cle_metier", business_key("pay_date", "employee_id", "pay_code", F.coalesce("budget_post", F.lit(POST_DEFAULT)),
                                                   "amount_cents", "employer_cents")))


def stream_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, max_files: int = 50,
                  periods: DataFrame | None = None, codes_dim: DataFrame | None = None, after_epoch=None):
    """M1: ingest every file arriving in ``landing``; returns the finished query (availableNow).

    The stream tells which files have arrived; each is read with its own
    encoding, separator and header (A1), so column order and spelling may differ
    from file to file. With ``periods``, valid lines outside open periods are
    refused with the alert ``PERIODE_FERMEE`` (D17); the calendar is read once, when the
    stream starts, and stored: an epoch does not derive it again.

    With ``codes_dim`` the fact load (E7) follows in the same epoch. The business
    key holds the pay date, so a line can only repeat one of its own date: the
    epoch reads the stored keys of its dates and of no other. Lines and stored keys are
    dealt once, by date and key, and written from there. ``after_epoch(dates)``
    is called with the epoch's pay dates once it is published, also when a
    published epoch is retried, so what follows (a refresh) must bear repeats."""
    src = text_lines(spark.readStream.format("text").option("recursiveFileLookup", True)
                     .option("maxFilesPerTrigger", max_files).load(landing))

    opened = None
    if periods is not None:
        opened = stored(periods.filter(F.col("status") == OPEN_STATUS).select("pay_date", F.lit(True).alias("_open")), "open-periods")

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        if _exists(session, f"{out}/published/epoch-{epoch_id}.json"):  # a retry of a whole epoch
            if after_epoch:
                mine = published(session, out, "lines").filter(F.col("epoch") == epoch_id)
                after_epoch([r[0] for r in mine.select("pay_date").distinct().collect()])
            return
        formats = F.broadcast(file_formats(batch))  # one row per file of the epoch (max_files): no line is shuffled for them
        staged = stage_batch(read_canonical(batch, formats), canonical=True)
        if opened is not None:
            closed = F.col("is_valid") & F.col("_open").isNull()
            staged = staged.join(F.broadcast(opened), "pay_date", "left").withColumn(  # one row per pay date
                "validation_errors", F.when(closed, F.array(F.lit("PERIODE_FERMEE"))).otherwise(F.col("validation_errors"))) \
                .withColumn("is_valid", F.col("is_valid") & ~closed).drop("_open")
        staged = staged.persist(StorageLevel.DISK_ONLY)  # three tables from one reading of the files
        attempt = f"a{uuid.uuid4().hex}"  # a letter first: no partition value that looks like a number
        mark = [F.lit(epoch_id).alias("epoch"), F.lit(attempt).alias("attempt")]
        valid = staged.filter("is_valid")
        (valid.drop("validation_errors", "is_valid").select("*", F.year("pay_date").alias("pay_year"), *mark)
         .write.mode("append").partitionBy("epoch", "attempt", "pay_year").parquet(f"{out}/lines"))
        (staged.filter(~F.col("is_valid")).select("file_path", "source_row_no", F.explode("validation_errors").alias("alert_type"), *mark)
         .write.mode("append").partitionBy("epoch", "attempt").parquet(f"{out}/alerts"))
        sizes = {r[0]: r[1] for r in valid.groupBy("pay_date").count().collect()}  # the calendar bounds them
        if codes_dim is not None:
            before = published(session, out, "fact", list(sizes))
            parts = {d: n // LINES_A_FILE + 1 for d, n in sizes.items() if n >= LINES_A_FILE}

            def dealt(df):  # keys are moved as their 16 bytes
                n = F.coalesce(F.create_map(*[F.lit(x) for item in parts.items() for x in item])[F.col("pay_date")], F.lit(1)) if parts else F.lit(1)
                return df.withColumn("cle_metier", F.unhex("cle_metier")).withColumn("_part", F.pmod(F.xxhash64("cle_metier"), n))
            rows = load_fact(dealt(fact_lines(staged, epoch_id)), codes_dim, dealt(before) if before is not None else None, dealt_by=("pay_date", "_part"))
            (rows.withColumn("cle_metier", F.lower(F.hex("cle_metier"))).select("*", *mark)
             .write.mode("append").option("compression", "zstd").partitionBy("pay_date", "epoch", "attempt").parquet(f"{out}/fact"))
        publish(session, out, epoch_id, attempt)
        staged.unpersist()
        if after_epoch:
            after_epoch(list(sizes))

    q = (src.writeStream.foreachBatch(write_epoch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State of the queries started inside lives in RocksDB (local disk, checkpointed), not on the heap."""
    old = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, old)


def stream_dedup(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, max_files: int = 64):
    """M2: drop re-sent lines by business key, however late they come.

    The state has one entry per business key: its first line, and the first and
    last time a micro-batch brought it. ``current_timestamp()`` is one value for a
    micro-batch, kept in the checkpoint's offset log, so a retry sees it again: a key
    is new exactly if both times are equal, and then its first line of the batch
    (smallest batch and row) is written. A key's work does not depend on how much is
    stored, no event-time limit drops a back-dated line or lets an old duplicate
    through, and a retried epoch overwrites its own output."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    staged = validate_lines(s).filter("is_valid").drop("validation_errors").withColumn("cle_metier", business_key(
        "pay_date", "employee_id", "pay_code", F.coalesce("budget_post", F.lit("N/A")), "amount_cents",
        "employer_cents"))
    order = ["batch_id", "source_row_no"]
    line = F.struct(*order, *[c for c in staged.columns if c not in ("cle_metier", *order)])  # ordered by its first fields
    keyed = (staged.withColumn("_at", F.current_timestamp()).groupBy("cle_metier")
             .agg(F.min(line).alias("_line"), F.min("_at").alias("_first"), F.max("_at").alias("_last")))

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        (batch.filter(F.col("_first") == F.col("_last")).select("_line.*", "cle_metier")
         .write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}"))

    with rocksdb_state(spark):
        q = (keyed.writeStream.outputMode("update").foreachBatch(write_epoch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def stream_kpi(spark: SparkSession, source: str, schema: T.StructType, periods: DataFrame, out: str,
               checkpoint: str, max_files: int = 64):
    """M3: daily tumbling-window totals of lines in open periods (update mode, epoch-keyed sink).

    State is one row per pay date of an open period, so no event-time limit is
    needed and a line of any age still reaches its day. ``min(pay_date)`` names
    each window, so the result does not depend on the session time zone."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    gated = s.filter(F.col("pay_date").isNotNull()).join(
        F.broadcast(periods.filter(F.col("status") == OPEN_STATUS).select("pay_date")), "pay_date", "left_semi")
    agg = (gated.withColumn("event_ts", F.col("pay_date").cast("timestamp"))
           .groupBy(F.window("event_ts", "1 day"))
           .agg(F.min("pay_date").alias("pay_date"), F.sum("amount_cents").alias("net_cents"),
                F.count(F.lit(1)).alias("n_lines")))

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        (batch.select("pay_date", "net_cents", "n_lines")
         .write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}"))

    q = (agg.writeStream.outputMode("update").foreachBatch(write_epoch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_kpi_month(spark: SparkSession, source: str, schema: T.StructType, periods: DataFrame, out: str,
                     checkpoint: str, max_files: int = 64):
    """M3: calendar-month totals of lines in open periods (update mode, epoch-keyed sink); state is one row per month."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    gated = s.filter(F.col("pay_date").isNotNull()).join(
        F.broadcast(periods.filter(F.col("status") == OPEN_STATUS).select("pay_date")), "pay_date", "left_semi")
    agg = (gated.withColumn("month_start", F.date_trunc("month", F.col("pay_date").cast("timestamp")))
           .groupBy("month_start")
           .agg(F.date_format(F.min("pay_date"), "yyyy-MM").alias("mois"), F.sum("amount_cents").alias("net_cents"),
                F.count(F.lit(1)).alias("n_lines")))

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        (batch.select(F.col("mois").alias("pay_date"), "net_cents", "n_lines")
         .write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}"))

    q = (agg.writeStream.outputMode("update").foreachBatch(write_epoch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_kpi(spark: SparkSession, out: str) -> DataFrame:
    """M3 read side: the latest value of every window across epochs (``max_by`` on the epoch)."""
    r = spark.read.parquet(out)
    return r.groupBy("pay_date").agg(F.max_by("net_cents", "epoch").cast("long").alias("net_cents"),
                                     F.max_by("n_lines", "epoch").cast("long").alias("n_lines"))
