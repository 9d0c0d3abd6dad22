"""The training-data pipeline: documents in, token files out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next stage's docs. All but the last return the
columns of ``documents``.

Cases, stage by stage (each stage's own module has the details):

* language_id: null texts and texts without a letter have no language and go, whatever
  their lang says; repeated rows are judged alike; null lang is no label.
* simhash_near_dedup: of each group the row with the smallest doc_id stays (null ids last),
  of equal ids the one with the smallest hash of its text, of exact repeats one row. Null and
  empty texts have fingerprint zero and are one group.
* decontaminate: null and word-less texts have no hits and stay; repeated rows get the same verdict.
* mix_sources: null text has size 0 and comes with each whole pass over its source; null source is a
  source of its own; rows that repeat are drawn on their own and come as often as all of them together.
* token_output: null text is the end id alone; null doc_ids come first, equal ones by a hash of their text.

Very long texts are taken whole, extra columns are carried to the last stage, and an empty
table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paysift.llm.common import stored
from paysift.llm.decontaminate import clean
from paysift.llm.language_id import accepted, fit
from paysift.llm.mixing import mixed
from paysift.llm.simhash import one_of_each
from paysift.llm.token_files import op8_token_files
from paysift.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, trained on all labelled rows; documents without a determined language go."""
    return accepted(docs, fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; one document of each group stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; contaminated documents go."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; documents come as often as the mix takes them."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; one row per document read back from the token files."""
    return op8_token_files(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: The stages are no SQL (fingerprints, permuted blocks, tokeniser); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
