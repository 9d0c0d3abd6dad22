"""Trigram index for the employee search.

Posting lists of the three-character parts of every normalised name and of every
employee number. A posting carries the columns that the search shows, so one list is
all that a search reads: that of the rarest trigram of the needle, whose rows are then
verified with the same ``contains`` as the scan. Lists are dealt to ``PARTS``
partitions by a hash of the trigram and sorted by it, so Spark prunes to one partition
and to the row groups of one trigram. Needles of fewer than three characters have no
trigram; for them the names themselves are read, one row per employee.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.functions.names import norm_text

PARTS = 64
NAME, NUMBER = "name", "number"


def _grams(text: Column) -> Column:
    """Distinct parts of three characters."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def build_index(emp: DataFrame, path: str) -> None:
    """Write the posting lists, the sizes of the lists and the names of ``emp`` under ``path``."""
    shown = F.struct(*[F.col(f"`{c}`") for c in emp.columns])
    fields = [F.struct(F.lit(NAME).alias("field"), norm_text(F.col("nom_complet")).alias("text")),
              F.struct(F.lit(NUMBER).alias("field"), F.col("matricule_norm").alias("text"))]
    texts = emp.select(shown.alias("row"), F.explode(F.array(*fields)).alias("_f")).select("row", "_f.*").filter("text IS NOT NULL")
    texts.write.mode("overwrite").partitionBy("field").parquet(f"{path}/names")
    postings = texts.withColumn("gram", F.explode(_grams(F.col("text")))).withColumn("part", _part(F.col("gram")))
    # a trigram that most names hold is a long list: the range sort spreads it over files
    (postings.repartitionByRange("part", "field", "gram", "text").sortWithinPartitions("part", "field", "gram")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings"))
    (emp.sparkSession.read.parquet(f"{path}/postings").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").parquet(f"{path}/sizes"))


def _matches(spark: SparkSession, path: str, field: str, needle: str) -> DataFrame | None:
    """Rows whose ``field`` contains ``needle``; None if no list can hold any."""
    grams = sorted({needle[i:i + 3] for i in range(len(needle) - 2)})
    if not grams:
        return spark.read.parquet(f"{path}/names").filter((F.col("field") == field) & F.col("text").contains(F.lit(needle))).select("row")
    sizes = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/sizes").filter((F.col("field") == field) & F.col("gram").isin(grams)).collect()}
    if len(sizes) < len(grams):
        return None
    gram = min(grams, key=lambda g: (sizes[g], g))
    part = spark.range(1).select(_part(F.lit(gram))).first()[0]
    lists = spark.read.parquet(f"{path}/postings").filter((F.col("part") == part) & (F.col("field") == field) & (F.col("gram") == gram))
    return lists.filter(F.col("text").contains(F.lit(needle))).select("row")


def find(spark: SparkSession, path: str, q: str, numbers: bool = True) -> DataFrame:
    """Employees whose name holds ``q`` (accents and case aside) or, with ``numbers``, whose number holds it."""
    name = spark.range(1).select(norm_text(F.lit(q))).first()[0]
    found = [_matches(spark, path, NAME, name)] + ([_matches(spark, path, NUMBER, q)] if numbers else [])
    found = [f for f in found if f is not None]
    if not found:
        return spark.read.parquet(f"{path}/names").filter(F.lit(False)).select("row.*")
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1]).dropDuplicates()
    return rows.select("row.*")


def search_indexed(spark: SparkSession, path: str, tx: DataFrame, q: str, status: str | None = None) -> DataFrame:
    """I3 over the index: the rows of ``search.search_employees``. Only the lines of the employees found are aggregated."""
    e = find(spark, path, q)
    if status:
        e = e.filter(F.col("statut") == status)
    last = tx.join(e.select("employee_id"), "employee_id", "left_semi").groupBy("employee_id").agg(F.max("pay_date").alias("derniere_paie"))
    return e.join(last, "employee_id", "left").select("employee_id", "matricule_norm", "nom_complet", "statut", "derniere_paie")


def list_indexed(spark: SparkSession, path: str, text: str, status: str | None = None, categorie: str | None = None, titre: str | None = None) -> DataFrame:
    """I4 over the index: the rows of ``search.list_employees`` with a text, ordered."""
    e = find(spark, path, text, numbers=False)
    for column, value in (("statut", status), ("categorie_emploi", categorie), ("titre_emploi", titre)):
        if value:
            e = e.filter(F.col(column) == value)
    return e.orderBy("nom_complet", "employee_id")
