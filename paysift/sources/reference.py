"""Small reference tables used by the screen views (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Pay-code families (overtime family 'HS').
FAMILY_ROWS = [("105", "HS"), ("101", "BASE")]


def code_families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILY_ROWS, "pay_code string, famille string")
