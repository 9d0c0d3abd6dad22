"""Structured Streaming restarts: the checkpoint makes ingestion incremental and idempotent."""

from paysift.sources.payfile import FILE_HEADERS
from paysift.sources.sinks import work_dir
from paysift.streaming.ingest import stream_ingest


def _file(path, rows):
    import os
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part.csv", "w", encoding="utf-8") as f:
        f.write(";".join(FILE_HEADERS) + "\n")
        for r in rows:
            f.write(";".join(r) + "\n")


def _row(i, mat, amount):
    return [str(i), "Cadre", "", "Analyste", "2025-11-20", mat, f"Employe{i}, Test", "Gains", "SAL", "Salaire",
            "0-001-10-000", "", amount, "0,00", amount]


def test_restart_is_incremental_and_idempotent(spark):
    landing, out, ck = work_dir(spark, "st-landing"), work_dir(spark, "st-out"), work_dir(spark, "st-ckpt")
    _file(f"{landing}/a", [_row(1, "1001", "100,00"), _row(2, "1002", "n/a")])
    stream_ingest(spark, landing, out, ck)
    first = spark.read.parquet(f"{out}/lines").count()
    assert first == 1  # the unparsable amount is rejected, not ingested
    assert spark.read.parquet(f"{out}/alerts").count() == 1

    stream_ingest(spark, landing, out, ck)  # restart, nothing new arrived
    assert spark.read.parquet(f"{out}/lines").count() == first

    _file(f"{landing}/b", [_row(3, "1003", "250,00"), _row(4, "1004", "(5,00)")])
    stream_ingest(spark, landing, out, ck)  # only the new file is processed
    lines = spark.read.parquet(f"{out}/lines")
    assert lines.count() == 3
    assert sorted(r["amount_cents"] for r in lines.collect()) == [-500, 10000, 25000]
