"""Parameter and synonym tables.

Small reference tables: generic key -> value parameters, calculation flags and
category synonyms (``ARRAY<STRING>``). They stay tiny whatever the ledger size,
so joins against them may be broadcast. Upsert = anti-join on the key + union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seeded parameters (employer rate default 0.15, sign fallback on).
PARAM_ROWS = [("part_employeur_taux", 0.15, None), ("use_sign_fallback", 1.0, None)]
# Default category synonyms.
SYNONYM_ROWS = [
    ("Gains", ["gains", "revenu", "salaire", "brut", "base"]),
    ("Deductions", ["deductions", "retenues", "retenue", "debit"]),
]

PARAM_SCHEMA = "param_key string, value_num double, value_text string"
SYNONYM_SCHEMA = "categorie string, synonyms array<string>"


def params(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Parameter table from ``path`` (parquet) or the seeded defaults."""
    if path:
        return spark.read.schema(PARAM_SCHEMA).parquet(path)
    return spark.createDataFrame(PARAM_ROWS, PARAM_SCHEMA)


def synonyms(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path:
        return spark.read.schema(SYNONYM_SCHEMA).parquet(path)
    return spark.createDataFrame(SYNONYM_ROWS, SYNONYM_SCHEMA)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; others are kept."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def categorise(df: DataFrame, label_col: str, syn: DataFrame, out: str = "categorie") -> DataFrame:
    """Category of a free-text label by synonym membership (``array_contains`` semantics).

    The synonym table is a small catalogue: it is exploded and broadcast, and
    the match is an equi join on the normalised label."""
    exploded = F.broadcast(syn.select(F.col("categorie").alias(out), F.explode("synonyms").alias("_syn")))
    return df.join(exploded, F.lower(F.trim(F.col(label_col))) == F.col("_syn"), "left").drop("_syn")
