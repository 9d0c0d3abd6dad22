"""Keyed dedup state, atomic epochs with the fact load, and refresh of changed dates."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from paysift.operators import kpi
from paysift.operators import refresh as RF
from paysift.operators import warehouse as W
from paysift.sources import fixtures as fx
from paysift.sources.sinks import stored, work_dir
from paysift.streaming import ingest as M

from .test_streaming import _file, _row

LINE = ("batch_id int, source_file string, source_row_no long, employee_id long, pay_date date, pay_code string, categorie_paie string, "
        "amount_cents long, employer_cents long, budget_post string")


def line(batch, row, date, amount=100, emp=1):
    return (batch, f"f{batch}", row, emp, dt.date.fromisoformat(date), "101", "Gains", amount, 0, None)


def arrive(spark, source, *rows):
    spark.createDataFrame(list(rows), LINE).coalesce(1).write.mode("append").parquet(source)


def ids(spark, out):
    return sorted((r.batch_id, r.source_row_no) for r in spark.read.parquet(out).select("batch_id", "source_row_no").collect())


def commits(checkpoint):
    return sorted(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())


def forget_commit(checkpoint):
    """The epoch ran but its commit was lost: Spark runs it again."""
    last = commits(checkpoint)[-1]
    os.remove(f"{checkpoint}/commits/{last}")
    crc = f"{checkpoint}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    return last


@pytest.fixture
def dedup(spark):
    source, out, ck = work_dir(spark, "sd-src"), work_dir(spark, "sd-out"), work_dir(spark, "sd-ck")
    schema = spark.createDataFrame([], LINE).schema
    return source, out, ck, lambda: M.stream_dedup(spark, source, schema, out, ck)


def test_dedup_state_refuses_old_duplicates_without_stored_lines(spark, dedup):
    source, out, ck, run = dedup
    arrive(spark, source, line(1, 7, "2015-01-15"), line(1, 3, "2015-01-15"), line(1, 4, "2015-01-15", 200))
    run()
    assert ids(spark, out) == [(1, 3), (1, 4)]  # the first row of the batch stays
    shutil.rmtree(f"{out}/epoch=0")  # what was written is never read again
    arrive(spark, source, line(2, 1, "2015-01-15"), line(2, 2, "2025-01-15"), line(2, 1, "2015-01-15", 300))
    run()
    assert ids(spark, out) == [(2, 1), (2, 2)]
    assert spark.read.parquet(out).filter("batch_id = 2 AND source_row_no = 1").first().amount_cents == 300


def test_dedup_restart_and_retry(spark, dedup):
    source, out, ck, run = dedup
    arrive(spark, source, line(1, 1, "2015-01-15"))
    run()
    run()  # nothing new
    arrive(spark, source, line(2, 1, "2015-01-15"), line(2, 5, "2016-01-15"), line(2, 6, "2016-01-15"))
    run()
    want = ids(spark, out)
    assert want == [(1, 1), (2, 5)]
    forget_commit(ck)
    run()  # the last epoch again, from the state before it
    assert ids(spark, out) == want
    arrive(spark, source, line(3, 9, "2016-01-15"))
    run()
    assert ids(spark, out) == want


@pytest.fixture
def ingest(spark):
    landing, out, ck = work_dir(spark, "si-landing"), work_dir(spark, "si-out"), work_dir(spark, "si-ck")
    codes = spark.createDataFrame([("SAL", "Salaire", "Gains")], "pay_code string, label string, categorie_paie string")

    def run(**options):
        return M.stream_ingest(spark, landing, out, ck, codes_dim=codes, **options)
    return landing, out, ck, codes, run


def facts(spark, out):
    return sorted((r.employee_id, r.amount_cents, r.is_adjustment) for r in M.published(spark, out, "fact").collect())


def batch_load(spark, out, codes):
    lines = M.published(spark, out, "lines").withColumn("is_valid", F.lit(True))
    loaded = W.load_fact(M.fact_lines(lines.drop("epoch", "attempt"), 0), codes)
    return sorted((r.employee_id, r.amount_cents, r.is_adjustment) for r in loaded.collect())


def test_fact_of_the_stream_equals_the_batch_load(spark, ingest):
    landing, out, ck, codes, run = ingest
    _file(f"{landing}/a", [_row(1, "01001", "100,00"), _row(2, "1002", "n/a"), _row(3, "1003", "-5,00")])
    run()
    assert facts(spark, out) == [("1001", 10000, False), ("1003", -500, True)]
    _file(f"{landing}/b", [_row(9, "1001", "100,00"), _row(4, "1004", "7,00")])  # one line sent again
    run()
    assert facts(spark, out) == batch_load(spark, out, codes) and len(facts(spark, out)) == 3
    assert M.published(spark, out, "lines").count() == 4 and M.published(spark, out, "alerts").count() == 1


def test_unpublished_attempts_stay_invisible_and_are_repeated(spark, ingest):
    landing, out, ck, codes, run = ingest
    _file(f"{landing}/a", [_row(1, "1001", "100,00")])
    run()
    _file(f"{landing}/b", [_row(2, "1002", "50,00")])
    run()
    want = facts(spark, out)
    # the last epoch wrote its tables, but the driver died before it published and committed
    last = forget_commit(ck)
    os.remove(f"{out}/published/epoch-{last}.json")
    for rest in (f"{out}/published/.epoch-{last}.json.crc",):
        if os.path.exists(rest):
            os.remove(rest)
    assert facts(spark, out) == [("1001", 10000, False)]
    run()
    assert facts(spark, out) == want == batch_load(spark, out, codes)
    assert M.published(spark, out, "lines").count() == 2
    # published, but not committed: the retry writes nothing
    forget_commit(ck)
    run()
    assert facts(spark, out) == want and M.published(spark, out, "lines").count() == 2


def test_epochs_read_the_fact_of_their_own_dates_only(spark, ingest):
    landing, out, ck, codes, run = ingest
    _file(f"{landing}/a", [_row(1, "1001", "100,00")])
    run()
    assert M.published(spark, out, "fact", [dt.date(1999, 1, 1)]) is None
    other = _row(2, "1002", "50,00")
    other[4] = "2025-12-05"
    _file(f"{landing}/b", [other])
    run()
    one = M.published(spark, out, "fact", [dt.date(2025, 11, 20), dt.date(1999, 1, 1)])
    assert one.count() == 1 and M.published(spark, out, "fact").count() == 2
    assert all("pay_date=2025-11-20" in f or "/published/" in f for f in one.inputFiles())


def test_refresh_follows_the_epochs(spark, ingest):
    landing, out, ck, codes, run = ingest
    tables, seen = work_dir(spark, "si-kpi"), []

    def after(dates):
        seen.append(dates)
        fact = M.published(spark, out, "fact").withColumnRenamed("poste_budgetaire", "budget_post")
        RF.refresh(fact, fact, dates, tables)
    _file(f"{landing}/a", [_row(1, "1001", "100,00")])
    run(after_epoch=after)
    other = _row(2, "1002", "50,00")
    other[4] = "2025-12-05"
    _file(f"{landing}/b", [other])
    run(after_epoch=after)
    assert seen == [[dt.date(2025, 11, 20)], [dt.date(2025, 12, 5)]]
    got = {r.pay_date: r.gains_brut for r in RF.refreshed(spark, tables, "kpi_period").collect()}
    assert got == {dt.date(2025, 11, 20): 100.0, dt.date(2025, 12, 5): 50.0}


def test_refresh_of_changed_dates_equals_a_full_run(spark, sf):
    lines = stored(fx.ledger(spark, sf), "rf-lines", "pay_year")
    dates = RF.changed_dates(lines)
    some, gone = dates[3:6], dates[5]
    out = work_dir(spark, "rf-out")
    RF.refresh(lines, lines, dates, out)
    edited = lines.filter((F.col("pay_date") != gone)).withColumn(
        "amount_cents", F.when(F.col("pay_date").isin(some), F.col("amount_cents") + 1).otherwise(F.col("amount_cents")))
    assert RF.of_dates(edited, some).count() < lines.count()
    RF.refresh(edited, edited, some, out)
    RF.refresh(edited, edited, some, out)  # once more changes nothing
    for name, full in (("kpi_period", kpi.kpi_by_period(edited)), ("kpi_star", kpi.kpi_star(edited))):
        got = RF.refreshed(spark, out, name).withColumnRenamed("pay_date", "date_paie").select(*full.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    assert gone not in {r.pay_date for r in RF.refreshed(spark, out, "snapshot").collect()}


def test_refresh_reads_the_changed_years_only(spark, sf):
    lines = stored(fx.ledger(spark, sf), "rf-years", "pay_year")
    day = RF.changed_dates(lines)[0]
    plan = RF.of_dates(lines, [day])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"pay_year#" in plan.split("PartitionFilters")[1].split("]")[0]
    files = {f"pay_year={day.year}" in f for f in RF.of_dates(lines, [day]).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files == {True}


def test_refresh_without_dates_does_nothing(spark, sf):
    lines = fx.ledger(spark, sf)
    out = work_dir(spark, "rf-none")
    RF.refresh(lines, lines, [], out)
    assert not os.path.exists(out)
