"""Ledger kept as two bucketed tables with one partition per year and a default partition.

* ``<name>``: all columns, bucketed and sorted by employee: employee joins (D10, D11) read it in place.
* ``<name>_rows``: date, file and row of every line, bucketed and sorted by (file, row): an import that asks which of its
  lines are new (E12) and the join coverage (D18) read it in place.

A join on the bucket columns shuffles the other side only, whatever the ledger holds. Years outside the declared range,
and lines without date, go to the partition ``default``; ``attach_year`` moves a year out of it. Both tables are external
tables in the shared folder, so any session can open them (``open_store``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.session import shuffle_partitions

from .sinks import stored

DEFAULT = "default"
ROW_KEY = ["source_file", "source_row_no"]


def year_part(first_year: int, last_year: int) -> Column:
    """Partition of a line: its pay year inside the declared years, else ``default``."""
    year = F.year("pay_date")
    return F.when(year.between(first_year, last_year), year.cast("string")).otherwise(F.lit(DEFAULT))


def _tables(name: str) -> dict[str, list[str]]:
    return {name: ["employee_id"], f"{name}_rows": ROW_KEY}


def _write(lines: DataFrame, name: str, path: str, buckets: int, new: bool = False) -> None:
    """Both tables from one derivation of ``lines``: that of the rows from the stored lines, which in a new store are the first table."""
    if not new:
        lines = stored(lines, "append")
    for table, keys in _tables(name).items():
        df = lines if table == name else (lines.sparkSession.table(name) if new else lines).select("pay_date", *ROW_KEY, "year_part")
        (df.repartition(buckets, *keys).write.mode("append").partitionBy("year_part").bucketBy(buckets, *keys).sortBy(*keys)
         .option("path", f"{path}/{table}").saveAsTable(table))


def create_store(lines: DataFrame, name: str, path: str, first_year: int, last_year: int, buckets: int | None = None) -> None:
    """Write ``lines`` to new tables ``name`` and ``name_rows``. By default as many buckets as shuffle partitions:
    with fewer, Spark may prefer to shuffle both sides of a join."""
    _write(lines.withColumn("year_part", year_part(first_year, last_year)), name, path, buckets or shuffle_partitions(lines.sparkSession), new=True)


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def append(lines: DataFrame, name: str, path: str, first_year: int, last_year: int) -> None:
    """Add lines to both tables."""
    _write(lines.withColumn("year_part", year_part(first_year, last_year)), name, path, _buckets(lines.sparkSession, name))


def of_years(spark: SparkSession, name: str, years: Iterable[int]) -> DataFrame:
    """Lines of some pay years: their partitions and the default one are read."""
    years = sorted(years)
    return spark.table(name).filter(F.col("year_part").isin([str(y) for y in years] + [DEFAULT])).filter(F.year("pay_date").isin(years))


def attach_year(spark: SparkSession, name: str, path: str, year: int) -> None:
    """Move the lines of ``year`` from the default partition to one of their own.

    The year's lines are added first and then the default partition is replaced by the rest, each from a copy
    written beforehand; after a failure in between, ``detach`` the year's partition and start again."""
    rest, moved = {}, {}
    for table in _tables(name):
        lines = stored(spark.table(table).filter(F.col("year_part") == DEFAULT), "attach")
        mine = F.coalesce(F.year("pay_date") == year, F.lit(False))
        moved[table], rest[table] = lines.filter(mine), lines.filter(~mine)
    n = _buckets(spark, name)
    for table, keys in _tables(name).items():
        columns = spark.table(table).columns
        (moved[table].withColumn("year_part", F.lit(str(year))).select(*columns).repartition(n, *keys)
         .write.mode("append").partitionBy("year_part").bucketBy(n, *keys).sortBy(*keys).option("path", f"{path}/{table}").saveAsTable(table))
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (year_part = '{DEFAULT}') PURGE")
        _drop_folder(spark, f"{path}/{table}/year_part={DEFAULT}")
        (rest[table].select(*columns).repartition(n, *keys)
         .write.mode("append").partitionBy("year_part").bucketBy(n, *keys).sortBy(*keys).option("path", f"{path}/{table}").saveAsTable(table))


def detach(spark: SparkSession, name: str, path: str, part: str) -> None:
    """Drop one partition of both tables with its files."""
    for table in _tables(name):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (year_part = '{part}')")
        _drop_folder(spark, f"{path}/{table}/year_part={part}")


def _drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_store(spark: SparkSession, name: str, path: str, schema, buckets: int) -> None:
    """Make the tables of a store that another session wrote known to this one."""
    for table, keys in _tables(name).items():
        columns = [f for f in schema.fields if table == name or f.name in ("pay_date", *ROW_KEY)]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        by = ", ".join(keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}, year_part STRING) USING parquet PARTITIONED BY (year_part) "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'")
        spark.catalog.recoverPartitions(table)


def new_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """E12 against the store: lines whose (date, file, row) the ledger does not hold.

    The date is compared as a residual, so that the join is on the bucket columns and ``rows`` is not shuffled."""
    a, b = lines.alias("a"), rows.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ROW_KEY]
    return a.join(b, same[0] & same[1] & (F.datediff("a.pay_date", "b.pay_date") == 0), "left_anti")


def drop_store(spark: SparkSession, name: str) -> None:
    """Forget both tables (their files stay)."""
    for table in _tables(name):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
