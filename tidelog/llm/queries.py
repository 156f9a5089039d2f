"""The registered corpus queries, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import (
    conversations,
    jaccard,
    language,
    licenses,
    neighbours,
    packing,
    quality,
    sharding,
    tokens,
    toxicity,
    transducer,
    variants,
    warc,
)
from tidelog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

# The pages have no time of capture; it follows their ids.
FIRST_CAPTURE_MS = 1_600_000_000_000


def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similarity_join(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return transducer.round_trip(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op4_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return warc.archive(pages, FIRST_CAPTURE_MS + 1000 * F.col("page_id")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("notices")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    ).drop("clause")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_report(
        conversations.damaged(table(spark, folder, "conversations"))
    )


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc_index": op4_warc_index,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_toxicity": op12_toxicity,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op4_warc_index": """
        WITH page AS (
            SELECT page_id, coalesce(html, '') AS payload,
                   strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), numbered AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM page
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM numbered
    """,
}
