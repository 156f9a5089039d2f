"""A corpus pipeline: language, quality, near copies, packing.

Each stage works on all that its predecessor kept, and its result is written
as Parquet before the next one reads it.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard, language, packing, quality
from tidelog.llm.common import staged, table

# A language is accepted from this mean probability on.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents whose language is unknown or uncertain."""
    found = language.predicted(docs, language.fit(docs), ["*"])
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return found.where(known).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that fail the base limits or the learned decision list."""
    rules = quality.fit(docs, table(spark, folder, "labels"))
    return quality.judged(docs, rules, ["*"]).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of every component: the one with the smallest id.

    Of rows that repeat an id, all stay or go together; rows without an id or
    without words stay.
    """
    found = jaccard.similarity_join(docs)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", best_fit_packing),
]

# Trained models and a search decide on rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
