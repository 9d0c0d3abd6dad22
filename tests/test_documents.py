"""VARIANT documents: unknown fields survive, fields are read by path."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paysift.sources import documents as D
from paysift.sources import fixtures as fx
from paysift.sources.sinks import work_dir

A, B, C = dt.date(2025, 1, 15), dt.date(2025, 1, 31), dt.date(2025, 2, 15)


def docs(spark, *rows):
    return spark.createDataFrame([(d, json.dumps(x), dt.datetime(2025, 3, 1)) for d, x in rows], "pay_date date, j string, computed_at timestamp").select(
        "pay_date", F.parse_json("j").alias("doc"), "computed_at")


def read(df):
    return {r.pay_date: json.loads(r.j) for r in df.select("pay_date", F.to_json("doc").alias("j")).collect()}


def test_unknown_fields_survive_storing_and_merging(spark):
    out = work_dir(spark, "docs")
    old = docs(spark, (A, {"cards": {"deductions": -1.5}, "notes": {"by": "Zoé", "tags": [1, "x", None]}}), (B, {"cards": {}, "extra": True}))
    D.store_documents(old, out)
    stored = D.read_documents(spark, out)
    assert read(stored)[A]["notes"] == {"by": "Zoé", "tags": [1, "x", None]}
    new = docs(spark, (A, {"cards": {"deductions": -2.5}, "tables": [1]}), (C, {"cards": {"deductions": 0.0}}))
    merged = read(D.merge_documents(new, stored))
    assert merged == {A: {"cards": {"deductions": -2.5}, "tables": [1], "notes": {"by": "Zoé", "tags": [1, "x", None]}}, B: {"cards": {}, "extra": True},
                      C: {"cards": {"deductions": 0.0}}}


def test_paths_of_absent_and_other_kinds_are_null(spark):
    df = docs(spark, (A, {"a": {"b": 3}, "t": "text"}))
    r = df.select(D.path("doc", "$.a.b", "bigint").alias("b"), D.path("doc", "$.a.c", "bigint").alias("c"), D.path("doc", "$.t", "bigint").alias("t"),
                  D.path("doc", "$.t").alias("s")).first()
    assert tuple(r) == (3, None, None, "text")


def test_replacing_one_date_keeps_the_others(spark, sf):
    out = work_dir(spark, "docs")
    lg = fx.ledger(spark, sf)
    D.store_documents(D.snapshot_documents(lg), out)
    before = {r.pay_date: r.nb_transactions for r in D.snapshot_figures(D.read_documents(spark, out)).collect()}
    day = min(before)
    D.store_documents(D.snapshot_documents(lg.filter(F.col("pay_date") == day).limit(1)), out)
    after = {r.pay_date: r.nb_transactions for r in D.snapshot_figures(D.read_documents(spark, out)).collect()}
    assert after == before | {day: 1} and before[day] > 1


@pytest.mark.parametrize("empty", [True, False])
def test_audit_documents(spark, empty):
    lines = spark.createDataFrame([(A, 10), (A, 5), (B, 7)], "pay_date date, amount_cents long")
    gone, kept = lines.filter(F.col("pay_date") == (C if empty else A)), lines.filter(F.col("pay_date") != (C if empty else A))
    r = D.audit_documents({"ledger": gone}, {"ledger": kept}, A).select(F.to_json("before").alias("b"), F.to_json("after").alias("a")).first()
    assert json.loads(r.b) == {"rows": 3, "cents": 22} and json.loads(r.a) == ({"rows": 3, "cents": 22} if empty else {"rows": 1, "cents": 7})


def test_scratch_tables_go_when_the_session_ends(spark):
    import os

    from paysift import session
    from paysift.sources.sinks import stored
    others = list(session._SCRATCH)
    session._SCRATCH.clear()
    try:
        path = stored(spark.range(3), "scratch").inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "/")
        assert os.path.exists(path)
        session.remove_scratch()
        assert not os.path.exists(path) and not session._SCRATCH
    finally:
        session._SCRATCH.extend(others)
