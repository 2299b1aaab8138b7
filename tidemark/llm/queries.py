"""Queries of this package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, classifier, language, media, mixing, neardup, packing, quality_rules, resampling, sharding, token_counts, trie, url_filter
from tidemark.llm.common import durable, read, scratch

#: Parameters that the queries fix.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CONTEXT = 2048
SHARDS = 16
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
POLICY = "v2"
ACCEPT = 0.7
DRAWN_PERCENT, LEAST_WORDS, GAIN_BUCKETS, DRAW_SEED = 10, 20, 10_000, 2024
#: Conversations start with turns of the one whose number is the next multiple of the first below, fewer than the second.
GRAFT = (5, 9)
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Hosts that are blocked with all their subdomains; they name no rule.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as scope:
        rows = durable(classifier.measured(read(spark, sf_dir, "documents")), "measured")
        model = classifier.train_stored(rows, read(spark, sf_dir, "labels"))
        scored = rows.select(F.col("id").alias("doc_id"), classifier.held_out(F.col("id")).alias("held_out"), classifier.score_stored(model, F.col("x")).alias("score"))
        return scope.keep(scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int")), "scores")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.answers(token_counts.histogram(read(spark, sf_dir, "documents"), TOKENIZER))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER, CONTEXT)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(url_filter.key_of(r), r, v) for r, v in URL_RULES] + [(url_filter.key_of(h), None, "block") for h in LISTED_HOSTS]
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), url_filter.Index.build(entries))
    return judged.select("page_id", "judged.*")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(own), TOKENIZER))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.inspect(media.store_texts(read(spark, sf_dir, "documents")))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(read(spark, sf_dir, "documents"))
    return led.select("doc_id", *quality_rules.MEASURES[:5], quality_rules.rejected("base").alias("base_failed"), (~quality_rules.rejected(POLICY)).alias("kept"), "failed")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), WEIGHTS, MOST_EPOCHS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), DRAWN_PERCENT, LEAST_WORDS, GAIN_BUCKETS, 1, DRAW_SEED)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"), GRAFT)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_token_counts, op3_best_fit_packing, op4_url_filters, op5_sharding, op6_chat_formatting, op7_media_columns, op8_minhash_near_dedup, op9_quality_rules, op10_mixing, op11_language_id, op12_importance_resampling, op13_prefix_trie)}
