"""Structural profile of a message table.  Every report is one pass of partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph.functions import text as T
from deskgraph.functions.numeric import count_if, percent
from deskgraph.operators.sampling import seeded_sample

MISSING_PARENT_TEXT = "[Parent tweet text not found in sample/data]"
MISSING_PARENT_AUTHOR = "Customer"


def text_digest(text: Column) -> Column:
    """32-byte stand-in for a text as grouping key, so that long texts are not shuffled."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def profile_shape(rows: DataFrame) -> DataFrame:
    """One row per column: name, type, and the table's row and column counts."""
    columns = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type")) for n, t in rows.dtypes])
    return (
        rows.agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            "row_count",
            F.lit(len(rows.columns)).cast("bigint").alias("column_count"),
            F.explode(columns).alias("c"),
        )
        .select("c.column_name", "c.data_type", "row_count", "column_count")
    )


def profile_nulls(rows: DataFrame) -> DataFrame:
    """Null count and percentage of every column, from one aggregate row turned sideways."""
    counted = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in rows.columns])
    return counted.unpivot("_n", rows.columns, "column_name", "filled").select(
        "column_name",
        (F.col("_n") - F.col("filled")).alias("null_count"),
        percent(F.col("_n") - F.col("filled"), F.col("_n"), 2).alias("null_pct"),
    )


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Frequency and percentage of every value."""
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.select("value", "n", percent(F.col("n"), total, 1).alias("pct"))


def top_authors(rows: DataFrame, n: int = 20) -> DataFrame:
    """Most active outbound authors, with the number of distinct ones."""
    counts = rows.where(~F.col("inbound")).groupBy("author_id").agg(F.count(F.lit(1)).alias("replies"))
    return (
        counts.orderBy(F.desc("replies"), "author_id")
        .limit(n)
        .withColumn("unique_authors", counts.agg(F.count("author_id")).scalar())
    )


def duplicate_text_rate(rows: DataFrame, text: str = "text") -> DataFrame:
    """Texts beyond the first of each distinct one.

    Digests are grouped, not counted with ``distinct`` beside other aggregates, so one
    heavily repeated text collapses before the shuffle.
    """
    groups = rows.where(F.col(text).isNotNull()).groupBy(text_digest(F.col(text)).alias("_d")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("texts"),
        F.count(F.lit(1)).alias("distinct_texts"),
    ).select(
        "texts",
        "distinct_texts",
        (F.col("texts") - F.col("distinct_texts")).alias("duplicates"),
        percent(F.col("texts") - F.col("distinct_texts"), F.col("texts"), 2).alias("duplicate_pct"),
    )


def thread_field_coverage(rows: DataFrame) -> DataFrame:
    """How many messages name a parent and how many name a reply."""
    return rows.agg(
        F.count("in_response_to_tweet_id").alias("has_parent"),
        F.count("response_tweet_id").alias("has_response"),
        F.count(F.lit(1)).alias("_n"),
    ).select(
        "has_parent",
        percent(F.col("has_parent"), F.col("_n"), 2).alias("has_parent_pct"),
        "has_response",
        percent(F.col("has_response"), F.col("_n"), 2).alias("has_response_pct"),
    )


def non_ascii_rate(rows: DataFrame, text: str = "text") -> DataFrame:
    """Share of texts with any character beyond ASCII."""
    return rows.agg(
        F.count(text).alias("texts"),
        count_if(F.col(text).rlike(r"[^\x00-\x7F]")).alias("non_ascii"),
    ).select("texts", "non_ascii", percent(F.col("non_ascii"), F.col("texts"), 2).alias("non_ascii_pct"))


def sample_exchanges(rows: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """A few outbound replies with the message they answer.

    The ``n`` sampled replies pick their parents out of the table by a broadcast of at
    most ``n`` ids, so the table itself is never shuffled.
    """
    replies = seeded_sample(
        rows.where(~F.col("inbound") & F.col("in_response_to_tweet_id").isNotNull()), n, seed, "tweet_id"
    ).select(
        F.col("author_id").alias("brand"),
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        F.col("tweet_id").alias("brand_reply_id"),
        F.col("text").alias("brand_reply_text"),
    )
    wanted = replies.select("customer_tweet_id").distinct()
    parents = rows.select(
        F.col("tweet_id").alias("customer_tweet_id"), F.col("author_id").alias("_author"), F.col("text").alias("_text")
    ).join(F.broadcast(wanted), "customer_tweet_id", "left_semi")
    return replies.join(parents, "customer_tweet_id", "left").select(
        "brand",
        F.coalesce("_author", F.lit(MISSING_PARENT_AUTHOR)).alias("customer_author"),
        "customer_tweet_id",
        F.coalesce("_text", F.lit(MISSING_PARENT_TEXT)).alias("customer_text"),
        "brand_reply_id",
        "brand_reply_text",
    )


def inspection_report(rows: DataFrame, top: int = 20) -> DataFrame:
    """The whole profile as one row of nested values; duplicates and authors come in as scalars."""
    authors = top_authors(rows, top)
    duplicates = duplicate_text_rate(rows)
    nulls = profile_nulls(rows)
    inbound = value_counts(rows, "inbound")

    def packed(table: DataFrame, key: str, value: str) -> Column:
        return table.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()

    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("in_response_to_tweet_id").alias("has_parent"),
        F.count("response_tweet_id").alias("has_response"),
        count_if(F.col("text").rlike(r"[^\x00-\x7F]")).alias("non_ascii_messages"),
    ).select(
        "row_count",
        F.lit(len(rows.columns)).cast("bigint").alias("column_count"),
        F.array(*[F.lit(c) for c in rows.columns]).alias("columns"),
        packed(nulls, "column_name", "null_count").alias("missing_values"),
        packed(inbound, "value", "n").alias("inbound_distribution"),
        packed(authors, "author_id", "replies").alias("top_authors"),
        duplicates.select("duplicates").scalar().alias("exact_duplicate_texts"),
        F.struct("has_parent", "has_response").alias("threading"),
        "non_ascii_messages",
    )


__all__ = [
    "duplicate_text_rate",
    "inspection_report",
    "non_ascii_rate",
    "profile_nulls",
    "profile_shape",
    "sample_exchanges",
    "text_digest",
    "thread_field_coverage",
    "top_authors",
    "value_counts",
]
