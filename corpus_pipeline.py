"""A corpus pipeline over ``documents``.

Each stage reads what its predecessor kept and returns the columns of
``documents``; the last one returns the packed pieces: per piece its
document, place, ids and sequence. ``n_chars`` follows the text where a stage
rewrites it. Copies are told by id and text: rows of equal id and different
texts are different documents, and of rows equal in both one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import mix, ngram_join, packing, pii, quality
from eventlens.llm.queries import PII_KEY, tokenizer_file
from eventlens.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays."""
    return ngram_join.one_of_each(docs)


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(pii.pseudonymise(docs, PII_KEY)).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that takes a document."""
    return _recount(mix.mix_documents(docs)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # fewer words are kept than by the operator alone: the workers of earlier stages still hold their memory
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), cache_words=150_000)
    return pieces.select("doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", F.col("offset").cast("bigint").alias("offset"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("source_mix", source_mix), ("packed", packed)]

#: Tokens and pseudonyms are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
