import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts_by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long_text = "word and another one, with 4111111111111111 in it. " * 4000
    rows = [
        (None, "text without an id", "en", None, 1), (1, None, None, None, None), (2, "", "en", "s", 0),
        (3, " \n\t ", None, "s", 4), (4, long_text, "en", "s", len(long_text)), (5, long_text, "en", "s", 7),
        (6, "short", "en", "s", 5), (6, "short", "en", "s", 5), (7, "é" * 5000, "fr", "s", 5000),
        (8, "1" * 30000, None, "s", 3), (9, "<" * 3000 + "@" * 3000, None, "s", 3), (10, "\U0001d7d8 ＠ ​", None, None, 3),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with extra columns whose names the operators use themselves."""
    names = "score lang_pred mark node class start length fingerprint component_id held_out row size hash tokens item_id place end following"
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(n) for n in names.split()])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
