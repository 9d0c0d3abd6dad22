"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.session import scratch, shuffle_partitions
from paysift.sources.sinks import work_dir

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+`` (Java regex class).
SPACE = r"[\x20\x09-\x0D]+"

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character is left as it is."""
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def split_words(text: Column, separators: str = SPACE) -> Column:
    """Maximal runs between separators, empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns ``_id, _th`` that name a row: its doc_id and a hash of its text.

    Rows that repeat a doc_id with another text stay apart; exact repeats share
    a key and, having the same text, the same result."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit("\x00null"))).alias("_th")]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on ``_id, _th`` where a null doc_id equals a null doc_id."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def packed(docs: DataFrame) -> DataFrame:
    """``_row`` (all columns of ``docs``) with its key, so that no column name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())


def one_row_each(rows: DataFrame) -> DataFrame:
    """``rows`` with one row per key; only keys that come more than once (``_n``) are shuffled."""
    return rows.filter("_n = 1").unionByName(rows.filter("_n > 1").dropDuplicates(["_id", "_th"]))


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` (with ``options`` of the writer) to a fresh table in the shared folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs its running tasks only."""
    spark = df.sparkSession
    path = scratch(spark, work_dir(spark, name))
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a no-op where it is installed)."""
    import paysift
    root = os.path.dirname(os.path.dirname(os.path.abspath(paysift.__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([x for x in known if x] + [root])


def release_memory() -> None:
    """Give what a finished task has freed back to the system: an idle worker keeps it otherwise, next to a full heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, task: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with a task that needs this package."""
    importable(df.sparkSession)

    def run(batches):
        yield from task(batches)
        release_memory()
    return df.mapInArrow(run, schema)


def widths(spark: SparkSession) -> int:
    return shuffle_partitions(spark)
