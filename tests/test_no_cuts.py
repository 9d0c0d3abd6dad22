"""Inputs beyond the sizes at which results were once cut, and the rules for shared folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paysift import session
from paysift.operators import analytics, cleaning, reports, search, vectors, warehouse
from paysift.operators.lines import number_lines
from paysift.operators.topk import exact_quantiles
from paysift.streaming import ingest


def test_dedup_report_lists_every_value(spark):
    log = spark.createDataFrame([(1, dt.date(2025, 1, 15), f"c{i % 3}", 1000 + i, 500) for i in range(150)],
                                "batch_id int, pay_date date, pay_code string, employee_id long, amount_cents long")
    r = warehouse.dedup_report(log).first()
    assert r["nb_matricules"] == 150 and len(r["matricules_concernes"].split(", ")) == 150
    assert r["codes_paie_concernes"] == "c0, c1, c2" and r["montant_total_ignore"] == 750.0


def test_employee_list_has_no_limit(spark):
    emp = spark.createDataFrame([(i, str(i), f"Nom{i:03d}", "actif", "A", "T") for i in range(300)],
                                "employee_id long, matricule_norm string, nom_complet string, statut string, categorie_emploi string, titre_emploi string")
    assert search.list_employees(emp, status="actif").count() == 300
    tx = emp.select("employee_id", F.lit(dt.date(2025, 1, 15)).alias("pay_date"), F.lit("101").alias("pay_code"),
                    F.lit(1).cast("long").alias("amount_cents"), F.col("employee_id").alias("source_row_no"))
    assert search.ledger_page(tx, emp, limit=300).count() == 300


def test_new_hire_list_is_complete(spark):
    nh = spark.createDataFrame([(1, dt.date(2025, 1, 15), "f.csv", i, f"{i:06d}", i > 0) for i in range(200)],
                               "batch_id int, pay_date date, source_file string, employee_id long, matricule_norm string, est_nouveau boolean")
    nh = nh.withColumns({"max_precedent": F.lit(0), "max_actuel": F.lit(200), "date_precedente": F.lit(None).cast("date")})
    r = analytics.new_hire_stats(nh).first()
    assert (r["nouveaux_employes"], r["anciens_employes"]) == (199, 1)
    assert r["liste_nouveaux"].split(", ") == [f"{i:06d}" for i in range(1, 200)]


def test_pivot_keeps_every_category(spark):
    rows = [(dt.date(2025, 1, 15), "1", "A", c, 100 * (i + 1)) for i, c in enumerate(["Gains", "Déductions", "Avantages", None, "a.b"])]
    df = spark.createDataFrame(rows, "date_paie date, matricule string, nom_employe string, categorie_paie string, montant_employe long")
    r = reports.report_employee_pivot(df).first().asDict()
    assert (r["Gains"], r["Déductions"], r["Avantages"], r["N/A"], r["a.b"], r["Syndicats"]) == (1.0, -2.0, 3.0, 4.0, 5.0, 0.0)


def test_several_query_vectors(spark):
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "query_id string, q array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in vectors.cosine_topk(emb, q, 2).collect()}
    assert got == {("x", 49), ("x", 48), ("y", 0), ("y", 1)}
    with pytest.raises(ValueError):
        vectors.cosine_topk(emb, q.drop("query_id"), 2)


def test_top_movers_of_a_large_date(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 15), f"p{i:04d}", float(i)) for i in range(-1000, 1000)], "date_paie date, dim string, delta double")
    rows = reports.top_movers(df, "dim", 3).collect()
    assert {r["delta"] for r in rows if r["is_top_up"]} == {999.0, 998.0, 997.0}
    assert {r["delta"] for r in rows if r["is_top_down"]} == {-1000.0, -999.0, -998.0}


def test_stream_dedup_keeps_late_lines_and_drops_old_duplicates(spark, tmp_path):
    cols = "batch_id int, source_file string, source_row_no long, employee_id long, pay_date date, pay_code string, categorie_paie string, amount_cents long, employer_cents long, budget_post string"
    line = lambda b, r, d: (b, "f", r, 1, d, "101", "Gains", 100, 0, "0-1")
    new, old = dt.date(2025, 6, 15), dt.date(2010, 1, 15)
    for b, rows in enumerate([[line(1, 1, new), line(1, 2, old)], [line(2, 1, old), line(2, 2, dt.date(2009, 1, 15)), line(2, 3, new)]]):
        spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/src/b={b}")
    schema = spark.createDataFrame([], cols).schema
    ingest.stream_dedup(spark, f"{tmp_path}/src/*", schema, f"{tmp_path}/out", f"{tmp_path}/ck", max_files=1)
    got = sorted(r["pay_date"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [dt.date(2009, 1, 15), old, new]


def test_numbered_lines_split_a_hot_file(spark):
    rows = [("hot.csv", 3 * i) for i in range(9000)] + [(f"f{i % 50}.csv", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "source_file string, source_row_no long").repartition(5)
    got = number_lines(df, in_file="n").orderBy("line_no").collect()
    assert [(r["source_file"], r["source_row_no"]) for r in got] == sorted(rows)
    assert [r["line_no"] for r in got] == list(range(1, 10001))
    assert [r["n"] for r in got if r["source_file"] == "hot.csv"] == list(range(2, 9002))


def test_numbered_lines_with_far_off_and_huge_row_numbers(spark):
    """One row number far from the others, and numbers near the end of LONG, make neither a large range nor an overflow."""
    far = [("a", i) for i in range(6000)] + [("a", 10 ** 14)]
    huge = [("b", 9 * 10 ** 18 + i) for i in range(3000)] + [("b", -9 * 10 ** 18), (None, 1), ("c", None), ("c", 5), ("c", 5)]
    df = spark.createDataFrame(far + huge, "source_file string, source_row_no long").repartition(7)
    got = number_lines(df, in_file="n").orderBy("line_no").collect()
    want = sorted(far + huge, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    assert [(r["source_file"], r["source_row_no"]) for r in got] == want
    assert [r["line_no"] for r in got] == list(range(1, len(want) + 1))
    assert [r["n"] for r in got if r["source_file"] == "b"] == list(range(2, 3003))
    assert [r["n"] for r in got if r["source_file"] == "c"] == [2, 3, 4]
    from paysift.operators.lines import _ranges
    sizes = [r["count"] for r in _ranges(df.filter("source_file = 'a'").withColumn("_c", F.lit(1)), ["source_row_no"], 8)[0].groupBy("_range").count().collect()]
    assert max(sizes) < 2 * 6001 / 8


def test_exact_quantiles_in_two_lazy_passes(spark):
    """Hot group, outliers, ties, one value, nulls; a coarse sketch is refined to the exact value."""
    rows = ([("hot", float(i * i % 99991)) for i in range(20000)] + [("hot", 1e15), ("one", 7.0), ("two", 1.0), ("two", None), ("none", None), (None, 3.0), (None, 4.0)]
            + [("tie", 5.0)] * 500 + [("tie", 6.0)] * 500)
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    ref = {r["g"]: (*r["p"], r["n"]) for r in df.groupBy("g").agg(F.percentile("v", qs).alias("p"), F.count("v").alias("n")).collect() if r["n"]}
    for accuracy in (50, 10_000):
        lazy = exact_quantiles(df, ["g"], "v", qs, accuracy)
        got = {r["g"]: (*(r[f"q_{i}"] for i in range(len(qs))), r["n"]) for r in lazy.collect()}
        assert got.keys() == ref.keys()
        for g in ref:
            assert got[g] == pytest.approx(ref[g], rel=1e-9), g


def test_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Fake:
        class sparkContext:
            master = "spark://host:7077"
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake)


HEAD = ["matricule", "code de paie", "date de paie", "montant", "employé"]


def _landing(tmp_path):
    files = {
        "a.csv": (";", "utf-8-sig", HEAD, [["1", "101", "2025-08-28", "10,00", "Zoé"]]),
        "b.csv": (",", "cp1252", HEAD[::-1], [["plain", "20.50", "2025-08-28", "105", str(1000 + i)] for i in range(500)] + [["Noël €", "30.00", "2025-08-28", "450", "999"]]),
        "c c.csv": ("\t", "utf-8", [HEAD[1], HEAD[0], *HEAD[2:]], [["520", "3", "28/08/2025", "-4,00", "ß中"]]),
    }
    for name, (sep, enc, head, rows) in files.items():
        (tmp_path / name).write_bytes("".join(sep.join(r) + "\n" for r in [head, *rows]).encode(enc))
    return str(tmp_path)


def test_each_file_has_its_own_format(spark, tmp_path):
    from paysift.sources.payfile import read_pay_csv
    df = read_pay_csv(spark, _landing(tmp_path), canonical=True)
    rows = {r["matricule"]: r for r in df.collect()}
    assert len(rows) == 503
    assert (rows["1"]["nom_employe"], rows["1"]["code_paie"]) == ("Zoé", "101")
    assert (rows["999"]["nom_employe"], rows["999"]["montant_employe"]) == ("Noël €", "30.00")
    assert (rows["3"]["code_paie"], rows["3"]["nom_employe"]) == ("520", "ß中")


def test_stream_reads_each_file_by_its_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    landing = _landing(tmp_path / "in")
    periods = spark.createDataFrame([(dt.date(2025, 8, 28), "ouverte")], "pay_date date, status string")
    ingest.stream_ingest(spark, landing, f"{tmp_path}/out", f"{tmp_path}/ck", max_files=2, periods=periods)
    rows = {r["matricule"]: r for r in spark.read.parquet(f"{tmp_path}/out/lines").collect()}
    assert len(rows) == 503 and rows["3"]["pay_code"] == "520" and rows["3"]["amount_cents"] == -400 and rows["999"]["amount_cents"] == 3000
    closed = periods.withColumn("status", F.lit("fermée"))
    ingest.stream_ingest(spark, landing, f"{tmp_path}/out2", f"{tmp_path}/ck2", periods=closed)
    assert {r["alert_type"] for r in spark.read.parquet(f"{tmp_path}/out2/alerts").collect()} == {"PERIODE_FERMEE"}


def test_profiles_match_per_client(spark):
    from paysift.operators.profile import match_profiles
    sig = spark.createDataFrame([("f", "x", "A"), ("g", "x", "B"), ("h", "x", "C")], "file string, signature string, client string")
    prof = spark.createDataFrame([(1, "A", "x", 1), (2, "A", "x", 2), (3, "B", "x", 9)], "profile_id int, client string, signature string, updated_at int")
    assert {r["file"]: r["profile_id"] for r in match_profiles(sig, prof).collect()} == {"f": 2, "g": 3, "h": None}


def test_equal_file_of_a_period_is_imported_once(spark):
    from paysift.sources.sinks import new_files
    cur = spark.createDataFrame([("p1/a", "c", 1, "p1"), ("p1/b", "c", 1, "p1"), ("p2/a", "c", 1, "p2"), ("p3/a", "d", 1, "p3")], "file_path string, checksum string, n_bytes int, period string")
    seen = spark.createDataFrame([("p3", "d"), ("p9", "c")], "period string, checksum string")
    assert sorted(r["file_path"] for r in new_files(cur, seen).collect()) == ["p1/a", "p2/a"]


def _pay(rows):
    return [(dt.date(2025, 1, 15), m, f"n{m}", c, cents) for m, c, cents in rows]


PAY = "date_paie date, matricule string, nom_employe string, categorie_paie string, montant_employe long"


def test_pivot_negates_deductions_in_every_spelling(spark):
    df = spark.createDataFrame(_pay([("1", "Gains", 10000), ("1", "Déductions", 3000), ("2", "Gains", 10000), ("2", "DEDUCTIONS", -2000), ("2", "deductions", 500),
                                     ("2", "ASSURANCES", 100), ("3", None, 700)]), PAY)
    got = {r["matricule"]: r for r in reports.report_employee_pivot(df).collect()}
    assert (got["1"]["Déductions"], got["1"]["Net"]) == (-30.0, 70.0)
    assert (got["2"]["Deductions"], got["2"]["Assurances"], got["2"]["Net"]) == (-25.0, -1.0, 75.0)  # one column for all cases
    assert (got["3"]["N/A"], got["3"]["Gains"], got["3"]["Net"]) == (7.0, 0.0, 0.0)


def test_pivot_keeps_categories_beyond_the_columns(spark, monkeypatch):
    monkeypatch.setattr(reports, "MAX_CATEGORIES", 4)
    df = spark.createDataFrame(_pay([("1", f"c{i}", i) for i in range(9)] + [("1", "Gains", 100), ("2", "Déductions", 100)]), PAY)
    got = {r["matricule"]: r for r in reports.report_employee_pivot(df).collect()}
    assert got["1"]["autres"] == {f"c{i}": i / 100 for i in range(9)} and got["1"]["Net"] == 1.0
    assert got["2"]["autres"] == {"Déductions": -1.0} and got["2"]["Net"] == -1.0
    assert reports.report_employee_rows(df).count() == 11


def test_quality_suite_finds_what_it_tests(spark):
    from paysift.operators import kpi, quality
    cols = "pay_date date, employee_id long, pay_code string, categorie_paie string, amount_cents long, employer_cents long"
    day = dt.date(2025, 1, 15)
    good = spark.createDataFrame([(day, 1, "a", "Gains", 1000, 0), (day, 1, "b", "Deductions", -300, 5)], cols)
    bad = good.unionByName(spark.createDataFrame([(day, 1, "x", "Autre", 50, -1), (day, 1, "a", "Gains", -10, 0), (day, 1, "b", "Syndicats", 10, 0)], cols))
    stored = kpi.kpi_star_month(good)
    assert {r.test: r.n for r in quality.quality_suite(good, stored).collect()} == dict.fromkeys(
        ("net_identity", "negative_gains", "positive_deductions", "negative_employer_share"), 0)
    assert {r.test: r.n for r in quality.quality_suite(bad, stored).collect()} == {
        "net_identity": 0, "negative_gains": 1, "positive_deductions": 1, "negative_employer_share": 1}  # -10 and +10 cancel out
    assert quality.quality_suite(bad, kpi.kpi_star_month(bad)).filter("test = 'net_identity'").first().n == 1  # a line of no known category
    assert quality.quality_suite(good.limit(0), stored).filter("test = 'net_identity'").first().n == 1


def test_drop_empty_drops_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None), (None, "x", None)], "a int, b string, c double")
    got = cleaning.drop_empty(df)
    assert got.columns == ["a", "b"] and got.count() == 2
