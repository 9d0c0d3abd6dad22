"""Refresh of stored KPI tables for changed pay dates only.

The contract KPI (F2), the star KPI (F10) and the snapshot documents (A12) are
functions of one pay date's lines. After an import or a deletion, the pay dates
that changed are enough: their lines are read (year and date partitions prune
the scan), the tables are computed for them, and dynamic partition overwrite
replaces these dates and leaves the others as they are. A date whose last line
has gone keeps a marker row in its partition, which readers skip.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.sources.sinks import snapshot_frame

from . import kpi

TABLES = {
    "kpi_period": lambda lines, fact: kpi.kpi_by_period(lines).withColumnRenamed("date_paie", "pay_date"),
    "kpi_star": lambda lines, fact: kpi.kpi_star(fact).withColumnRenamed("date_paie", "pay_date"),
    "snapshot": lambda lines, fact: snapshot_frame(lines).drop("computed_at"),
}


def of_dates(lines: DataFrame, dates: Iterable[dt.date]) -> DataFrame:
    """The lines of some pay dates; literals, so that partitions by year or date prune when the scan is planned."""
    dates = sorted(dates)
    picked = lines.filter(F.col("pay_date").isin(dates) if dates else F.lit(False))
    if "pay_year" in lines.columns and dates:
        picked = picked.filter(F.col("pay_year").isin(sorted({d.year for d in dates})))
    return picked


def changed_dates(*lines: DataFrame) -> list[dt.date]:
    """Pay dates of added or removed lines. The calendar bounds the list, not the number of lines."""
    found: set[dt.date] = set()
    for part in lines:
        found |= {r[0] for r in part.select("pay_date").filter("pay_date IS NOT NULL").distinct().collect()}
    return sorted(found)


def refresh(lines: DataFrame, fact: DataFrame, dates: Iterable[dt.date], out: str) -> None:
    """Recompute every table of ``TABLES`` for ``dates`` and replace these dates under ``out``.

    Repeating it, or running it again after it failed half-way, ends in the same tables."""
    dates = sorted(dates)
    if not dates:
        return
    spark = lines.sparkSession
    asked = spark.createDataFrame([(d,) for d in dates], "pay_date date")
    lines, fact = of_dates(lines, dates), of_dates(fact, dates)
    for name, table in TABLES.items():
        rows = table(lines, fact).withColumn("_present", F.lit(True))
        (asked.join(rows, "pay_date", "left")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pay_date").parquet(f"{out}/{name}"))


def refreshed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A stored table with one row for every pay date that has lines."""
    return spark.read.parquet(f"{out}/{name}").filter("_present").drop("_present")
