"""A training corpus from `documents`: language ID, near-duplicates, personal data, mixing, packing.

Each stage reads what the one before has written, so a lost executor costs at most a stage's running
tasks. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickspark.llm import language, mix, neardup, pack, pii
from tickspark.llm.common import table, written


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is explained by a learnt language."""
    return language.explained(docs, language.labelled_sample(docs.where(language.learnable())))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8."""
    return neardup.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", known_languages), ("neardup", one_of_each), ("pii", without_personal_data), ("mixing", mixed), ("packing", packed)]
#: Trained models, sketches and packing are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
