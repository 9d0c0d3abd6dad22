"""Bucketed ledger store: default partition, attached years, and joins that leave the stored side in place."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from paysift.operators import quality as Q
from paysift.sources import ledger_store as LS
from paysift.sources.sinks import work_dir

LINES = [(e, dt.date(y, 3, 15), f"f{y}.csv", i, 100 + i) for i, (e, y) in enumerate((e, y) for e in range(1, 6) for y in (2003, 2004, 2005, 2031))]
SCHEMA = "employee_id long, pay_date date, source_file string, source_row_no long, amount_cents long"


@pytest.fixture
def store(spark):
    name, path = f"t_{uuid.uuid4().hex}", work_dir(spark, "t-store")
    lines = spark.createDataFrame(LINES + [(9, None, "f.csv", 99, 1)], SCHEMA)
    LS.create_store(lines, name, path, 2003, 2005)
    yield name, path, lines
    LS.drop_store(spark, name)


def parts(spark, name):
    return {r.year_part: r["count"] for r in spark.table(name).groupBy("year_part").count().collect()}


def shuffled(df, table):
    """Whether rows of ``table`` are dealt anew by a key."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in text.splitlines()]
    at = next(i for i, (_, x) in enumerate(depth) if f"FileScan parquet spark_catalog.default.{table}[" in x)
    level, above = depth[at][0], []
    for d, x in reversed(depth[:at]):
        if d < level:
            above.append(x)
            level = d
    return any("Exchange hashpartitioning" in x for x in above)


def test_default_partition_and_attached_year(spark, store):
    name, path, lines = store
    assert parts(spark, name) == parts(spark, f"{name}_rows") == {"2003": 5, "2004": 5, "2005": 5, "default": 6}
    assert LS.of_years(spark, name, [2031]).count() == 5
    LS.append(spark.createDataFrame([(1, dt.date(2032, 1, 1), "g", 1, 5), (1, dt.date(2004, 1, 1), "g", 2, 5)], SCHEMA), name, path, 2003, 2005)
    LS.attach_year(spark, name, path, 2031)
    assert parts(spark, name) == parts(spark, f"{name}_rows") == {"2003": 5, "2004": 6, "2005": 5, "2031": 5, "default": 2}
    got = spark.table(name).select(*SCHEMA.replace(",", "").split()[::2])
    assert got.count() == lines.count() + 2 and got.exceptAll(lines).count() == 2


def test_employee_join_reads_the_store_in_place(spark, store):
    name, _, lines = store
    emp = spark.createDataFrame([(i,) for i in range(1, 5)], "employee_id long")
    left = Q.orphans(spark.table(name), emp)
    assert sorted({r.employee_id for r in left.collect()}) == [5, 9]
    assert not shuffled(left, name) and shuffled(Q.orphans(spark.table(f"{name}_rows").withColumnRenamed("source_row_no", "employee_id"), emp), f"{name}_rows")


def test_new_lines_and_coverage_read_the_rows_in_place(spark, store):
    name, _, lines = store
    rows = spark.table(f"{name}_rows")
    moved = spark.createDataFrame([(1, dt.date(2003, 3, 31), "f2003.csv", 0, 1), (1, dt.date(2003, 3, 15), "f2003.csv", 777, 1)], SCHEMA)
    fresh = LS.new_lines(lines.filter("pay_date IS NOT NULL").unionByName(moved), rows)
    assert sorted(r.source_row_no for r in fresh.collect()) == [0, 777]  # another date or another row
    assert not shuffled(fresh, f"{name}_rows")
    half = lines.filter("source_row_no % 2 = 0")
    share = Q.join_coverage(rows, half, LS.ROW_KEY)
    assert share.first().n_matched == half.count() and not shuffled(share, f"{name}_rows")


def test_a_year_is_read_from_its_partition(spark, store):
    name, _, _ = store
    files = LS.of_years(spark, name, [2004]).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("year_part=2004" in r.f for r in files)


def test_another_session_opens_the_store(spark, store):
    name, path, lines = store
    n = LS._buckets(spark, name)
    LS.drop_store(spark, name)
    LS.open_store(spark, name, path, lines.schema, n)
    assert parts(spark, name)["default"] == 6 and LS._buckets(spark, f"{name}_rows") == n
