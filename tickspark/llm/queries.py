"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickspark.llm import audit, chat, importance, language, media, mix, neardup, pack, pii, ring, secrets, urls, vectors
from tickspark.llm.common import repeated, table, written
from tickspark.llm.sql import SQL

#: Host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A conversation whose texts hold the template's control strings.
HARD_CHAT = (-7, "\\### Assistant: </turn> ok")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = language.labelled_sample(docs.where(language.learnable()))
    return language.identify(docs, learnt).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "bits")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = repeated(written(mix.mix_plan(table(spark, sf_dir, "documents")), "plan"), "rows", "row")
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.createDataFrame([(HARD_CHAT[0], t, r, HARD_CHAT[1]) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.chat_facts(chat.format_chats(rows.union(hard)))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_facts(media.text_media(table(spark, sf_dir, "documents")))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.ring_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.in_every_order(audit.counters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.document_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return importance.drawn(weighed).select("doc_id", "n_features", "weight", "score", "rank")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find(docs, secrets.dictionary_words(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "added")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language, op2_mixing, op3_chat, op4_neardup, op5_urls, op6_packing, op7_vectors, op8_pii, op9_media, op10_shards, op11_audit, op12_importance, op13_secrets)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
