"""The subpackage's operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.llm import (
    byte_bpe,
    decontaminate,
    hashing_search,
    jaccard_join,
    language_id,
    lexical_search,
    line_dedup,
    preferences,
    quality,
    repair,
    sharding,
    substring_dedup,
    toxicity,
)
from phasewise.llm.staging import prepare, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_hashing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_search.nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(language_id.fold(3) == 1, F.lit(False))
    model = toxicity.train(docs, labels.filter(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = preferences.reply_preferences(table(spark, sf_dir, "conversations"))
    found = preferences.format_preferences(sides)
    both = [column for side in ("chosen", "rejected") for column in (
        preferences.render(F.col(side)).alias(side),
        preferences.mask(F.col(side)).alias(f"{side}_mask"))]
    return found.select("pair_id", "n_common", "prompt", *both)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped",
                        F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(4) == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
        public_tokenizers.PATTERN, keep_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shipped(run: Callable[[SparkSession, str], DataFrame]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(spark, sf_dir)

    return query


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(run) for name, run in globals().items()
            if name.startswith("op") and name[2].isdigit()}
