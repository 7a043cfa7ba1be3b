"""A corpus from ``documents`` to packed sequences: five operators, each on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, mixing, packing, pii, quality
from lodestone.llm.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shards of the source mix, and the bytes of text in a part of one.
SHARDS, PART_BYTES = 16, 32 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts, rejected documents go altogether."""
    cleaned = quality.clean_lines(docs, with_text=True).where("kept").withColumn("text", F.col("cleaned_text"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard.drop_near_duplicates(docs, n=5, percent=80).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    return pii.replace_personal_data(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it, in shards of random order.

    A shard of more than ``PART_BYTES`` is dealt to as many random parts as it needs, each in random order: no task
    grows with the input.
    """
    mixed = mixing.mix_sources(docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size")), n_shards=SHARDS)
    parts = 1 + int(1.5 * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)) // (SHARDS * PART_BYTES)
    copies = mixed.select(*COLUMNS, F.posexplode("shards").alias("copy", "shard")).withColumn("_order", F.xxhash64("doc_id", "text", "copy"))
    dealt = copies.withColumn("_part", F.pmod(F.col("_order"), F.lit(parts)))
    return dealt.repartition(SHARDS * parts, "shard", "_part").sortWithinPartitions("shard", "_part", "_order").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Tokens and near-duplicate components are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
