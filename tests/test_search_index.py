"""Trigram index and seek pages: the rows of the scan, read from less."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paysift.operators import name_index as NI
from paysift.operators import search as S
from paysift.sources import fixtures as fx
from paysift.sources.sinks import stored, work_dir

NAMES = ["Élodie Côté", "ELODIE  COTE", "Jean-Noël Roy", "noel", "Ng", None, "", "Élo", "%_[a-z]+", "Zoé 123"]
EMP = "employee_id long, matricule_norm string, nom_complet string, statut string, categorie_emploi string, titre_emploi string"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"{1000 + i}", n, "actif" if i % 2 else "inactif", "A", "T") for i, n in enumerate(NAMES)]
    rows += [(100 + i, f"9{i:03d}", f"Client{i}, Jean", "actif", None, None) for i in range(300)] + [(500, None, "Sans Numéro", "actif", "A", "T")]
    return spark.createDataFrame(rows, EMP).repartition(3)


@pytest.fixture(scope="module")
def index(spark, people):
    path = work_dir(spark, "names")
    NI.build_index(people, path)
    return path


@pytest.mark.parametrize("q", ["NOËL", "élo", "cote", "client12", "Client299, Jean", "ng", "n", "100", "9007", "%_[", "zzz", "clientx", "numéro", "éé"])
def test_same_rows_as_the_scan(spark, people, index, q):
    tx = spark.createDataFrame([(3, dt.date(2025, 1, 15)), (3, dt.date(2025, 2, 15)), (112, dt.date(2024, 1, 1))], "employee_id long, pay_date date")
    want = S.search_employees(people, tx, q)
    assert sorted(map(str, NI.search_indexed(spark, index, tx, q).collect())) == sorted(map(str, want.collect()))
    active = S.list_employees(people, status="actif", text=q)
    assert list(map(str, NI.list_indexed(spark, index, q, status="actif").collect())) == list(map(str, active.collect()))


def test_a_search_reads_one_posting_list(spark, index):
    found = NI._matches(spark, index, NI.NAME, "client299")
    parts = {f.split("part=")[1].split("/")[0] for f in found.inputFiles() if "part=" in f}
    read = {r.f.split("part=")[1].split("/")[0] for r in found.select(F.input_file_name().alias("f")).collect()}
    assert len(read) == 1 and read <= parts
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(gram," in plan
    rare = spark.read.parquet(f"{index}/postings").groupBy("gram").count().filter("gram = '299'").first()["count"]
    assert rare < 5


@pytest.fixture(scope="module")
def ledger(spark):
    days = [dt.date(2024, 1, 31), dt.date(2024, 6, 30), dt.date(2025, 1, 31), dt.date(2025, 6, 30)]
    rows = [(d, d.year, e, r, f"f{r % 2}", "101", 100 * r) for d in days for e in range(1, 6) for r in range(4)]
    rows += [(None, None, 1, 1, "f0", "101", 1), (None, None, 2, 1, "f0", "101", 1)]
    return stored(spark.createDataFrame(rows, "pay_date date, pay_year int, employee_id long, source_row_no long, source_file string, pay_code string, amount_cents long"),
                  "seek-ledger", "pay_year")


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame([(i, None if i == 5 else str(i), f"n{i}") for i in range(1, 6)], "employee_id long, matricule_norm string, nom_complet string")


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_pages_joined_are_the_ordered_ledger(spark, ledger, staff, limit):
    j = ledger.join(staff, "employee_id").orderBy(F.desc_nulls_last("pay_date"), *[F.asc_nulls_first(c) for c in S.SEEK_ORDER[1:]])
    want = [(r.matricule_norm, r.pay_date, r.source_row_no, r.source_file) for r in j.collect()]
    if limit == 1:
        want = want[:6]
    per_date = ledger.groupBy("pay_date").agg(F.count(F.lit(1)).alias("n"))
    for counts in (None, per_date):
        got, after = [], None
        while len(got) < len(want):
            page = S.ledger_page_after(ledger, staff, after, limit, counts)
            rows = page.collect()
            assert 0 < len(rows) <= limit
            got += [(r.matricule_norm, r.pay_date, r.source_row_no, r.source_file) for r in rows]
            after = S.cursor_of(page)
        assert got[:len(want)] == want
    if limit > 1:
        assert S.cursor_of(S.ledger_page_after(ledger, staff, after, limit)) is None


def test_a_page_reads_the_dates_that_fill_it(spark, ledger, staff):
    per_date = ledger.groupBy("pay_date").agg(F.count(F.lit(1)).alias("n"))
    after = (dt.date(2024, 6, 30), "5", 3, "f1")
    page = S.ledger_page_after(ledger, staff, after, 5, per_date)
    assert {r.pay_date for r in page.collect()} == {dt.date(2024, 1, 31)}
    assert S._page_end(per_date, after, 5) == dt.date(2024, 1, 31) and S._page_end(per_date, None, 25) == dt.date(2025, 1, 31)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "pay_year" in plan.split("PartitionFilters")[1][:200]


def test_stored_ledger_pages_equal_offset_pages(spark, sf):
    lg, emp = fx.ledger(spark, sf), fx.employees(spark, sf)
    first = S.ledger_page_after(lg, emp, None, 50)
    second = S.ledger_page_after(lg, emp, S.cursor_of(first), 50)
    old = S.ledger_page(lg, emp, limit=50, offset=50)
    assert [(r.matricule_norm, r.source_row_no) for r in second.collect()] == [(r.matricule_norm, r.source_row_no) for r in old.collect()]
