"""Registered queries of the operators, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from paysift.sources.tables import read_table

from . import chat_format, collocations, decontaminate, line_dedup, multiset_hash, quality_rules
from .decontaminate import op2_decontaminate
from .language_id import op10_language_id
from .mixing import op3_mix_sources
from .secrets import op9_secret_scan
from .simhash import op6_simhash_near_dedup
from .suffix_dedup import op7_suffix_dedup
from .token_alignment import op13_token_alignment
from .token_files import op8_token_files

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    def docs(s, d):
        return read_table(s, d, "documents")

    return {
        "op1_line_dedup": lambda s, d: line_dedup.op1_line_dedup(s, docs(s, d)),
        "op2_decontaminate": lambda s, d: op2_decontaminate(s, docs(s, d), read_table(s, d, "benchmark")),
        "op3_mix_sources": lambda s, d: op3_mix_sources(s, docs(s, d)),
        "op4_quality_rules": lambda s, d: quality_rules.op4_quality_rules(s, docs(s, d)),
        "op5_chat_format": lambda s, d: chat_format.op5_chat_format(s, read_table(s, d, "conversations")),
        "op6_simhash_near_dedup": lambda s, d: op6_simhash_near_dedup(s, docs(s, d)),
        "op7_suffix_dedup": lambda s, d: op7_suffix_dedup(s, docs(s, d)),
        "op8_token_files": lambda s, d: op8_token_files(s, docs(s, d)),
        "op9_secret_scan": lambda s, d: op9_secret_scan(s, docs(s, d)),
        "op10_language_id": lambda s, d: op10_language_id(s, docs(s, d)),
        "op11_collocations": lambda s, d: collocations.op11_collocations(s, docs(s, d)),
        "op12_document_fingerprints": lambda s, d: multiset_hash.op12_document_fingerprints(s, docs(s, d)),
        "op13_token_alignment": lambda s, d: op13_token_alignment(s, docs(s, d)),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op2_decontaminate": decontaminate.ORACLE,
            "op4_quality_rules": quality_rules.ORACLE, "op5_chat_format": chat_format.ORACLE,
            "op11_collocations": collocations.ORACLE, "op12_document_fingerprints": multiset_hash.ORACLE}
