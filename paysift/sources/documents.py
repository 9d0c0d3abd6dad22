"""Snapshot and audit documents as VARIANT.

A document has no fixed schema: fields that this version does not know are kept when it
is stored, read and changed, and any field is read by its path. Values stay typed
(numbers, strings, nested objects) in the binary form, so reading a path parses no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import SNAPSHOT_SCHEMA, snapshot_frame

#: Paths of the snapshot figures and their types.
CARDS = {"salaire_net_total": "double", "masse_salariale": "double", "deductions": "double", "net_moyen": "double",
         "nb_employes": "bigint", "nb_transactions": "bigint"}


def as_document(value: Column) -> Column:
    """A struct, array or map as a document."""
    return F.to_variant_object(value)


def path(doc: str | Column, at: str, kind: str = "string") -> Column:
    """The field of a document at a path (``$.cards.deductions``), null where it is absent or of another kind."""
    return F.try_variant_get(doc, at, kind)


def snapshot_documents(tx: DataFrame, top_n: int = 10) -> DataFrame:
    """One document per pay date (figures, top codes) with the time it was computed."""
    doc = F.from_json("snapshot", SNAPSHOT_SCHEMA)
    return snapshot_frame(tx, top_n).select("pay_date", as_document(doc).alias("doc"), "computed_at")


def store_documents(docs: DataFrame, out: str) -> None:
    """Replace the documents of the dates present in ``docs`` and keep the others."""
    (docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pay_date").parquet(out))


def merge_documents(new: DataFrame, old: DataFrame) -> DataFrame:
    """Documents of ``new`` over those of ``old``: the top-level fields that the new document has replace the old
    ones, all others stay, known or not. Dates of one side only are kept."""
    j = new.select("pay_date", F.col("doc").alias("_n"), F.col("computed_at").alias("_t")).join(
        old.select("pay_date", F.col("doc").alias("_o"), F.col("computed_at").alias("_u")), "pay_date", "full_outer")
    fields = "map<string, variant>"
    both = F.map_concat(F.map_filter(F.col("_o").cast(fields), lambda k, v: ~F.array_contains(F.map_keys(F.col("_n").cast(fields)), k)), F.col("_n").cast(fields))
    doc = F.when(F.col("_n").isNull(), F.col("_o")).when(F.col("_o").isNull(), F.col("_n")).otherwise(as_document(both))
    return j.select("pay_date", doc.alias("doc"), F.coalesce("_t", "_u").alias("computed_at"))


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def snapshot_figures(docs: DataFrame) -> DataFrame:
    """The figures of each snapshot, read by path, and the number of its top codes."""
    codes = path("doc", "$.tables.codes_top", "array<variant>")
    return docs.select("pay_date", *[path("doc", f"$.cards.{c}", t).alias(c) for c, t in CARDS.items()],
                       F.coalesce(F.size(codes), F.lit(0)).cast("long").alias("n_codes_top"))


def audit_documents(removed: dict[str, DataFrame], kept: dict[str, DataFrame], pay_date) -> DataFrame:
    """Audit rows (table, before, after) of a deleted pay date, as documents of counts and sums.

    ``removed`` and ``kept`` are the lines of each table that went and that stayed."""
    out = None
    for name, gone in removed.items():
        def summary(df):
            amounts = [F.sum("amount_cents").alias("cents")] if "amount_cents" in df.columns else []
            return df.agg(F.count(F.lit(1)).alias("rows"), *amounts)
        a, b = summary(gone), summary(kept[name])
        both = a.select(F.struct(*a.columns).alias("g")).crossJoin(b.select(F.struct(*b.columns).alias("k")))
        total = [(F.coalesce(F.col(f"g.{c}"), F.lit(0)) + F.coalesce(F.col(f"k.{c}"), F.lit(0))).alias(c) for c in a.columns]
        row = both.select(F.lit(pay_date).cast("date").alias("pay_date"), F.lit(name).alias("table"),
                          as_document(F.struct(*total)).alias("before"), as_document(F.col("k")).alias("after"))
        out = row if out is None else out.unionByName(row)
    return out
