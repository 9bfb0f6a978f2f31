"""Training corpus from raw documents: quality, near-duplicates, secrets, mixture of sources, packing.

Every stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; ``run`` writes each result to
the cluster's shared folder and reads it back.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgraph.llm import mixing, neardup, packing, quality, secrets
from deskgraph.llm.common import fresh, stored, table
from deskgraph.llm.queries import tokenizer_path

#: Near-duplicates of this pipeline: five-word shingles, four fifths of the union shared.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BAND = 4
#: Words that a worker of the packing stage keeps; executors hold what the stages before have left in their heaps.
CACHED_WORDS = 100_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score passes; the classifier is fitted on labelled rows of this input."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh("score")
    return quality.score(docs, field, into=score).where(F.col(score) >= quality.PASS_SCORE).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.keep_one(docs, similarity=SIMILARITY, words=SHINGLE_WORDS, band=BAND)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars counted again."""
    names = tuple(fresh(name) for name in secrets.PLACES)
    found = secrets.redacted(secrets.scan(docs, secrets.fitted(spark, docs), names=names), places=names[2])
    chars = F.when(F.size(names[2]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target weight asks for."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences that training reads."""
    return packing.pack(docs, tokenizer_path(), cached=CACHED_WORDS)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("secret_removal", secret_removal),
    ("source_mixture", source_mixture),
    ("packed_sequences", packed_sequences),
]

#: SQL states neither the classifier nor the packing; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents`` in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
