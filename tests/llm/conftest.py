from __future__ import annotations

import pytest
from pyspark.sql import Row

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_dir():
    return SMALL_DIR


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row.doc_id: row.text for row in documents.select("doc_id", "text").collect()}


LONG = "the long text goes on and on with many words of its own. " * 20_000

# Null and empty texts, a very long one, repeated rows, ties, odd characters;
# columns whose names the operators use themselves.
ODD = {
    1: None,
    2: "",
    3: "   \n\t ",
    4: "one",
    5: "the same five words here again and again",
    6: "The SAME five words here again and again",
    7: LONG,
    8: "é ÀÉ ΑΣ İ 中文字 😀 a\x1cb <|endoftext|> x  y\n z",
    9: "a" * 5000,
    10: "12345 67 $$$",
}


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        Row(doc_id=i, text=t, lang="en", row="r", id=7, size=1, label="l", score=0.5, fp=3)
        for i, t in ODD.items()
    ]
    schema = "doc_id bigint, text string, lang string, row string, id int, size int, label string, score double, fp bigint"
    return spark.createDataFrame([*rows, rows[4], rows[0]], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
