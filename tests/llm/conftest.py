import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

ODD_TEXTS = [
    None, "", "   \n\t ", "one", "One two", "a b c d e", "!!! ??? 123", "é" * 40 + " ÀÉ ß 中文 \U0001F600 words",
    "same text here for ties and repeated rows", "same text here for ties and repeated rows",
    "word " * 3000, "x" * 50_000, "nul \x00 inside and \x1c control \x85 marks \xa0 end",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, "src%d" % (i % 2) if i % 5 else None, len(t or ""), i, "x", 1.0, True)
            for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", "en", "src1", 3, 3, "x", 1.0, True)] * 2 + [(None, "no id at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "size long, term string, score double, open boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pytest_configure(config):
    config.addinivalue_line("markers", "llm: training-data operators")
