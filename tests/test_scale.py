"""What a query pays for grows with its rows, not with tasks times folders, epochs or repeated derivations."""

import glob
import re

from pyspark.sql import functions as F

from paysift.functions.keys import business_key
from paysift.sources.payfile import FILE_HEADERS, write_pay_files
from paysift.sources.sinks import work_dir
from paysift.streaming import ingest as M

from .test_streaming import _file, _row


def _local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_landing_has_files_by_data_not_by_task(spark):
    path = work_dir(spark, "sc-landing")
    raw = spark.range(0, 600, 1, 8).select(F.col("id").cast("string").alias("N de ligne"), F.concat(F.lit("f"), F.col("id") % 3).alias("source_file"))
    write_pay_files(raw, path)
    assert len(glob.glob(f"{_local(path)}/source_file=*/*.csv")) == 3  # 24 before
    back = spark.read.option("header", True).option("sep", ";").csv(path)
    assert back.groupBy("source_file").count().collect() and {r["count"] for r in back.groupBy("source_file").count().collect()} == {200}
    assert back.select("N de ligne").distinct().count() == 600


def test_the_calendar_is_derived_once_for_all_epochs(spark):
    landing, out, ck = work_dir(spark, "sc-in"), work_dir(spark, "sc-out"), work_dir(spark, "sc-ck")
    for i in range(3):
        _file(f"{landing}/{i}", [_row(i, f"10{i}", "100,00")])
    seen = spark.sparkContext.accumulator(0)

    def status(_):
        seen.add(1)
        return "ouverte"
    periods = spark.sql("SELECT DATE'2025-11-20' AS pay_date").withColumn("status", F.udf(status)("pay_date"))
    M.stream_ingest(spark, landing, out, ck, max_files=1, periods=periods)
    assert M.published(spark, out, "lines").select("epoch").distinct().count() == 3
    assert M.published(spark, out, "lines").count() == 3
    assert seen.value <= 2  # the filter and the column of one derivation; at least three before


def test_pieces_of_a_file_and_fact_files_by_date(spark):
    landing, out, ck = work_dir(spark, "sp-in"), work_dir(spark, "sp-out"), work_dir(spark, "sp-ck")
    money = F.concat(F.col("id").cast("string"), F.lit(",00"))
    texts = {"date de paie": F.concat(F.lit("2025-11-2"), (F.col("id") % 2).cast("string")), "matricule": F.col("id").cast("string"), "montant": money,
             "code de paie": F.lit("SAL"), "part employeur": F.lit("0,00")}
    raw = spark.range(1, 201, 1, 8).select(F.col("id").cast("string").alias("N de ligne"), *[F.coalesce(texts[h], F.lit("")).alias(h) if h in texts else
                                           F.lit("x").alias(h) for h in FILE_HEADERS[1:]], F.concat(F.lit("f"), F.col("id") % 2).alias("source_file"))
    write_pay_files(raw, landing, deliveries=2)
    assert len(glob.glob(f"{_local(landing)}/delivery=*/source_file=*/*.csv")) == 4
    codes = spark.createDataFrame([("SAL", "Salaire", "Gains")], "pay_code string, label string, categorie_paie string")
    M.stream_ingest(spark, landing, out, ck, max_files=3, codes_dim=codes)
    fact = M.published(spark, out, "fact")
    assert fact.select("epoch").distinct().count() == 2 and fact.count() == 200 and fact.select("cle_metier").distinct().count() == 200
    for epoch in (0, 1):  # a task of its own per key range wrote a file into every date before
        files = glob.glob(f"{_local(out)}/fact/pay_date=*/epoch={epoch}/*/*.parquet")
        assert len(files) == len({f.split("pay_date=")[1].split("/")[0] for f in files})


def _scans(plan, table):
    return plan.count(f"{table}.parquet")


def test_report_exports_derive_the_lines_once(spark, sf, monkeypatch):
    from paysift.operators import reports as R
    from paysift.plans import source_plans as SP
    seen = []
    for name in ("report_summary", "report_by_code", "report_by_post", "evolution", "anomaly_set", "period_deltas_by"):
        monkeypatch.setattr(R, name, lambda lines, *a, _f=getattr(R, name): (seen.append(lines), _f(lines, *a))[1])
    assert SP.a08e(spark, sf).count() == 7
    assert len(seen) == 6 and not any(_scans(d._jdf.queryExecution().toString(), "lineitem") for d in seen)


def _lineitem_scans(df):
    return _scans(df._jdf.queryExecution().executedPlan().toString(), "lineitem")


def test_field_issues_come_from_one_reading(spark, sf):
    from paysift.operators import quality as Q
    from paysift.plans import quality_plans as QP
    assert _lineitem_scans(QP.d02f(spark, sf)) == 1  # two before
    rows = spark.createDataFrame([("1", "a", ""), ("2", "", ""), ("3", "c", "d"), ("4", None, "x")], "id string, p string, r string")
    out = Q.stage_field_stats(Q.stage_fields(rows, {"f": ("p", F.trim), "g": ("r", F.trim)}, "id"))
    assert sorted(map(tuple, out.collect())) == [("f", 2, 4, 1, 3), ("g", 2, 4, 1, 3)]
    assert Q.stage_field_stats(Q.stage_fields(rows.filter("id = '3'"), {"f": ("p", F.trim)}, "id")).count() == 0


def _stored_columns(monkeypatch, module):
    seen = []
    monkeypatch.setattr(module, "stored", lambda df, name, *by, _f=module.stored: (seen.append((name, df.columns)), _f(df, name, *by))[1])
    return seen


def test_validity_without_error_lists(spark):
    from paysift.operators import quality as Q
    rows = spark.createDataFrame([(None, "1", "c", 1, 1), ("2020-01-01", " ", "c", 1, 1), ("2020-01-01", None, "c", 1, 1), ("2020-01-01", "1", "", 1, 1),
                                  ("2020-01-01", "1", "c", None, 1), ("2020-01-01", "1", "c", 1, -1), ("2020-01-01", "1", "c", 1, None), (None,) * 5],
                                 "pay_date string, employee_id string, pay_code string, amount_cents long, employer_cents long")
    v = Q.validate_lines(rows)
    assert [r.is_valid for r in v.collect()] == [False] * 6 + [True, False]
    assert v.filter("is_valid <> (size(validation_errors) = 0) OR is_valid IS NULL").count() == 0
    assert "PART_EMPLOYEUR" not in v.filter("is_valid").select("pay_date")._jdf.queryExecution().optimizedPlan().toString()  # no list is built


def test_imports_keep_narrow_staging(spark, sf, monkeypatch):
    from paysift.plans import quality_plans as QP
    seen = _stored_columns(monkeypatch, QP)
    QP.e12(spark, sf)
    assert [c for n, c in seen if n == "staging"] == [QP.IMPORT_COLUMNS]  # error lists and keys were written before


def test_diagnosis_derives_the_lines_once(spark, sf):
    from paysift.plans import quality_plans as QP
    assert _lineitem_scans(QP.d19(spark, sf)) == 0  # three before: all read the stored staging


def test_fact_staging_without_keys(spark, sf, monkeypatch):
    from paysift.plans import quality_plans as QP
    seen = _stored_columns(monkeypatch, QP)
    fact = QP.loaded_fact(spark, sf)
    columns = dict(seen)["staging"]
    assert not {"cle_metier", "validation_errors", "is_valid"} & set(columns)  # written before
    assert fact.select("cle_metier").distinct().count() == fact.count()


def test_fact_keeps_the_first_line_of_a_key(spark):
    from paysift.operators import warehouse as W
    codes = spark.createDataFrame([("c", "C", "Gains")], "pay_code string, label string, categorie_paie string")
    rows = [("k", b, f"f{b}", r, 1, None, "c", None, 5, 0, True) for b, r in ((2, 1), (1, 9), (1, 4))]
    lines = spark.createDataFrame(rows, "cle_metier string, batch_id int, source_file string, source_row_no long, employee_id long, pay_date date, "
                                  "pay_code string, budget_post string, amount_cents long, employer_cents long, is_valid boolean")
    loaded = W.load_fact(lines, codes)
    assert [(r.source_batch_id, r.source_file, r.source_row_no) for r in loaded.collect()] == [(1, "f1", 4)]
    assert "min_by" not in loaded._jdf.queryExecution().optimizedPlan().toString()


def test_profile_counts_values_once(spark, monkeypatch):
    from paysift.operators import profile as P
    from paysift.plans import profile_plans as PP
    seen = _stored_columns(monkeypatch, P)
    rows = spark.createDataFrame([("A-1", "x"), ("A-1", None), ("B-2", "12"), ("b2", " ")], "a string, b string")
    prof = P.registry_profile(rows, ["a", "b"], PP.REGISTRY)
    assert [n for n, _ in seen] == ["value-counts"]
    assert "LogicalRDD" not in prof._jdf.queryExecution().optimizedPlan().toString()  # the lines are read by no later pass
    vc = P.value_counts(P.unpivot_values(rows, ["a", "b"]))
    one = sorted(map(tuple, P.mask_profile(vc, ("A", "9", "-")).collect()))
    assert one == [("a", "A-9", 3, 4, 0.75, 0.25, 3), ("b", "99", 1, 2, 0.5, 0.5, 2)]


def test_ledger_store_derives_its_lines_once(spark):
    import uuid
    from paysift.sources import ledger_store as LS
    seen = spark.sparkContext.accumulator(0)

    def count(r):
        seen.add(1)
        return f"f{r}"
    lines = spark.range(20).select(F.udf(count)("id").alias("source_file"), F.col("id").alias("source_row_no"), F.col("id").alias("employee_id"),
                                   F.expr("date_add(DATE'1992-01-01', CAST(id * 100 AS INT))").alias("pay_date"), F.lit(1).alias("amount_cents"))
    name, path = f"sc_{uuid.uuid4().hex}", work_dir(spark, "sc-store")
    LS.create_store(lines, name, path, 1992, 1994)
    assert seen.value == 20  # 40 before
    LS.append(lines, name, path, 1992, 1994)
    assert seen.value == 40  # 80 before
    assert spark.table(name).count() == spark.table(f"{name}_rows").count() == 40
    LS.drop_store(spark, name)


def test_pay_files_formats_are_read_once(spark, tmp_path, monkeypatch):
    from paysift.sources import payfile as PF
    seen = _stored_columns(monkeypatch, PF)
    (tmp_path / "a.csv").write_text('n;x\n1;\n"2";""\n3;"a;""b"""\n;"\n4\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("x,n\nb1,\n,5\n", encoding="utf-8")
    df = PF.read_pay_csv(spark, str(tmp_path))
    assert sorted(map(tuple, df.select("n", "x").collect()), key=str) == sorted(
        [("1", None), ("2", ""), ("3", 'a;"b"'), (None, '"'), ("4", None), (None, "b1"), ("5", None)], key=str)
    assert [n for n, _ in seen] == ["formats"]


def test_numbering_does_not_carry_labels(spark, sf, monkeypatch):
    from paysift.plans import analytics_plans as AP
    seen = []
    monkeypatch.setattr(AP, "number_lines", lambda df, _f=AP.number_lines: (seen.append(df), _f(df))[1])
    df = AP.f14(spark, sf)
    assert "nom_employe" not in seen[0].columns and _lineitem_scans(seen[0]) == 0  # numbered with all attributes, derived twice before
    assert df.columns[-1] == "line_no" and df.agg(F.count_distinct("line_no") - F.max("line_no")).first()[0] == 0


def test_both_copies_of_a_file_come_from_one_derivation(spark, sf, monkeypatch):
    from paysift.plans import source_plans as SP
    paths, made = [], []
    monkeypatch.setattr(SP.SK, "work_dir", lambda s, n, _f=SP.SK.work_dir: (paths.append(_f(s, n)), paths[-1])[1])
    monkeypatch.setattr(SP, "raw_pay_file", lambda *a, _f=SP.raw_pay_file: (made.append(1), _f(*a))[1])
    n = SP.a07(spark, sf).count()
    assert made == [1]  # derived for each copy before
    files = {c: {f.split("source_file=")[1].split("/")[0]: open(f, "rb").read() for f in glob.glob(f"{_local(paths[0])}/{c}/source_file=*/*.csv")}
             for c in ("copy=a", "copy=b")}
    assert files["copy=a"] == files["copy=b"] and len(files["copy=a"]) == n + 1


def test_dedup_state_carries_the_order_once(spark, monkeypatch):
    source, out, ck = work_dir(spark, "sm-src"), work_dir(spark, "sm-out"), work_dir(spark, "sm-ck")
    line(spark, source)
    ordered = []
    monkeypatch.setattr(M.F, "min_by", lambda *a: ordered.append(a))  # the line and, again, its batch and row
    M.stream_dedup(spark, source, spark.read.parquet(source).schema, out, ck)
    assert not ordered and [(r.batch_id, r.source_row_no, r.source_file) for r in spark.read.parquet(out).collect()] == [(1, 3, "f1")]


def line(spark, source):
    rows = spark.createDataFrame([(1, "f0", 7), (2, "f0", 1), (1, "f1", 3)], "batch_id int, source_file string, source_row_no long")
    rows.selectExpr("*", "1L AS employee_id", "DATE'2015-01-15' AS pay_date", "'101' AS pay_code", "'Gains' AS categorie_paie", "100L AS amount_cents",
                    "0L AS employer_cents", "CAST(NULL AS STRING) AS budget_post").coalesce(1).write.parquet(source)


def _readings(monkeypatch, table):
    """Grows by one for each time that the fixture views read ``table``."""
    from paysift.sources import fixtures as fx
    seen = []
    monkeypatch.setattr(fx, "read_table", lambda s, d, name, _f=fx.read_table: (name == table and seen.append(name), _f(s, d, name))[1])
    return seen


def _text_columns(df):
    return set(df.columns) & {*FILE_HEADERS, "matricule_raw", "nom_complet", "titre_emploi", "categorie_emploi", "source_file", "label"}


def test_landing_lines_are_moved_as_numbers(spark, sf, monkeypatch):
    from paysift.plans import profile_plans as PP, source_plans as SP
    from paysift.sources import payfile
    seen = []
    monkeypatch.setattr(payfile, "together", lambda df, *by, _f=payfile.together: (seen.append(df), _f(df, *by))[1])
    n = SP.a01(spark, sf).count()
    assert PP.c16(spark, sf).count() > 0 and len(seen) == 2
    for df in seen:
        assert not _text_columns(df) and df.count() == n  # all 15 texts before


def test_checksum_lines_are_moved_as_numbers(spark, sf, monkeypatch):
    from paysift.plans import source_plans as SP
    moved = []

    def raw(s, d, arranged=None, *keep, _f=SP.raw_pay_file):
        return _f(s, d, lambda lines: (moved.append(lines), arranged(lines))[1], *keep)
    monkeypatch.setattr(SP, "raw_pay_file", raw)
    assert SP.a07(spark, sf).count() > 0
    assert len(moved) == 1 and not _text_columns(moved[0])  # texts were repartitioned before


def test_lines_without_an_employee_have_no_texts_of_one(spark, sf, tmp_path):
    from paysift.sources.payfile import raw_pay_file
    for t in ("lineitem", "orders", "part", "nation"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    c.filter("c_custkey % 3 > 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey"))).write.parquet(f"{tmp_path}/customer.parquet")
    got = raw_pay_file(spark, str(tmp_path)).select("N de ligne", *[f"`{h}`" for h in ("matricule", "employé", "titre d'emploi", "catégorie d'emploi")])
    whole = raw_pay_file(spark, sf).select(*got.columns)
    known = whole.filter("cast(trim(matricule) AS long) % 3 = 1")
    assert got.count() == whole.count() > known.count() > 0
    assert got.filter("matricule IS NOT NULL").exceptAll(known).count() == 0 and known.exceptAll(got).count() == 0
    assert got.filter("matricule IS NULL AND (`employé` IS NOT NULL OR `titre d'emploi` IS NOT NULL OR `catégorie d'emploi` IS NOT NULL)").count() == 0


def test_stream_derives_the_ledger_once_and_moves_no_line(spark, sf, monkeypatch):
    from paysift.plans import stream_plans as ST
    seen, plans = _readings(monkeypatch, "lineitem"), []

    def canonical(lines, formats, _f=M.read_canonical):
        out = _f(lines, formats)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(M, "read_canonical", canonical)
    assert ST.m01(spark, sf).count() > 0
    assert len(seen) == 1  # once more for the calendar before
    assert plans and not any("SortMergeJoin" in p for p in plans)  # lines were shuffled by file to meet its format


def test_fact_lines_are_dealt_once(spark, monkeypatch):
    """Two epochs of the same lines: one shuffle of lines and stored keys, a date in several files where it is large."""
    landing, out, ck = work_dir(spark, "sd-in"), work_dir(spark, "sd-out"), work_dir(spark, "sd-ck")
    for i in range(2):
        _file(f"{landing}/{i}", [r[:4] + ["2025-11-21" if n > 200 else r[4]] + r[5:] for n, r in ((n, _row(n, f"1{n:03d}", f"{n},00")) for n in range(1, 203))])
    codes = spark.createDataFrame([("SAL", "Salaire", "Gains")], "pay_code string, label string, categorie_paie string")
    plans, parts = [], []

    def load(*a, _f=M.load_fact, **k):
        rows = _f(*a, **k)
        parts.append(sorted(tuple(r) for r in a[0].groupBy("pay_date").agg(F.count_distinct("_part")).select(F.dayofmonth("pay_date"), "*").drop("pay_date").collect()))
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows
    monkeypatch.setattr(M, "load_fact", load)
    monkeypatch.setattr(M, "LINES_A_FILE", 50, raising=False)
    M.stream_ingest(spark, landing, out, ck, max_files=1, codes_dim=codes)
    fact = M.published(spark, out, "fact")
    assert M.published(spark, out, "lines").count() == 404 and fact.count() == 202 == fact.select("cle_metier").distinct().count()
    moved = [[c for c in re.findall(r"Exchange hashpartitioning\((\w+)#", p) if c != "file_path"] for p in plans]  # but for the formats
    assert moved == [["pay_date"]] * 2  # by code, by key and for the stored keys before
    assert parts == [[(20, 5), (21, 1)]] * 2  # a date of 200 lines is cut, a small one is not
    again = fact.select(business_key("pay_date", "employee_id", "pay_code", "poste_budgetaire", "amount_cents", "employer_cents").alias("k"), "cle_metier")
    assert again.filter("k <> cle_metier").count() == 0


def test_sketches_from_one_derivation_without_a_row_for_each_column(spark, sf, monkeypatch):
    from paysift.operators import sketches as S
    from paysift.plans import profile_plans as PP
    seen, made = _readings(monkeypatch, "lineitem"), []
    monkeypatch.setattr(S, "column_sketches", lambda *a, _f=S.column_sketches: (made.append(_f(*a)), made[-1])[1])
    assert PP.c06_sketches(spark, sf).count() == 13 and len(seen) == 1  # two before
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "lineitem" not in plan


def test_generated_code_of_the_texts_is_compiled(spark, sf):
    """The JVM interprets methods of more than 8 000 bytes."""
    from paysift.sources import payfile
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before the run
    try:
        df = payfile.pay_texts(spark, sf, payfile.stored(payfile.pay_lines(spark, sf), "code-lines"))
        code = df._jdf.queryExecution().debug().codegenToSeq()
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(sizes) < 8000  # 8 625 with all texts in one projection
