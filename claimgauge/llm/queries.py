"""The registered query of each operator. Each applies its operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgauge.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    html_text,
    lm_score,
    ngram_join,
    ranked_search,
    repeats,
    rules,
    sharding,
    token_rollup,
    weak_labels,
    word_repeats,
)
from claimgauge.llm import statements as sql
from claimgauge.llm.shared import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARDS = 40


def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scored(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classes(table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Commits all documents, then changes of some: by crc32(doc_id as text) mod 64, those of 1 and 2 are
    deleted, 3 is revised to a longer text, 4 moves to the source ``moved`` (with a null doc_id none changes).
    A third batch restores the deleted of 2. The changes are committed once more, which changes nothing, and
    the batches are compacted on the way. The totals are those of the documents as they are then."""
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}", {
        "words": token_rollup.words,
        "byte_bpe_50k": token_rollup.byte_bpe(VOCABULARY, public_tokenizers.PATTERN),
    })
    documents = table(spark, folder, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 64
    changed = token_rollup.changes(
        documents.where(part.between(1, 4)), part <= 2,
        F.struct(F.when(part == 4, "moved").otherwise(F.col("source")).alias("source"), "lang",
                 F.when(part == 3, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")).alias("text")))
    rollup.commit("documents", token_rollup.inserts(documents))
    rollup.commit("changes", changed)
    rollup.compact()
    rollup.commit("restored", token_rollup.inserts(documents.where(part == 2)))
    rollup.commit("changes", changed)
    return rollup.totals()


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), SHARDS)


def op8_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.scored(table(spark, folder, "documents"))


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.texts(table(spark, folder, "pages"))


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return conversation_repair.digests(conversation_repair.damaged(conversations), conversations)


def op12_word_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return word_repeats.digests(table(spark, folder, "documents"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def registered() -> dict[str, Query]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_quality_rules": op2_quality_rules,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_decontamination": op4_decontamination,
        "op5_ngram_join": op5_ngram_join,
        "op6_token_counts": op6_token_counts,
        "op7_sharding": op7_sharding,
        "op8_weak_labels": op8_weak_labels,
        "op9_html_text": op9_html_text,
        "op10_repeats": op10_repeats,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_word_repeats": op12_word_repeats,
        "op13_ranked_search": op13_ranked_search,
    }


def statements() -> dict[str, str]:
    """SQL for DuckDB, where it can express a query."""
    return {
        "op11_conversation_repair": sql.conversation_repair(),
        "op12_word_repeats": sql.word_repeats(),
        "op13_ranked_search": sql.ranked_search(),
    }
