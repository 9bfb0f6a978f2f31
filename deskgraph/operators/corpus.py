"""From a message table to a clean, de-duplicated, split working set of (customer, reply) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T
from deskgraph.functions.numeric import count_if, percent
from deskgraph.operators.profile import text_digest
from deskgraph.operators.sampling import holdout_split, split_filter, take_seeded
from deskgraph.operators.skew import join_to_unique
from deskgraph.session import materialise


def _brand_replies(msgs: DataFrame, brand: str | Sequence[str] | Column) -> DataFrame:
    if isinstance(brand, Column):
        return msgs.where(brand)
    return msgs.where(F.col("author_id").isin([brand] if isinstance(brand, str) else list(brand)))


def reply_pairs(msgs: DataFrame, brand: str | Sequence[str] | Column) -> DataFrame:
    """Every message of the brand(s) with the inbound message it answers.

    ``brand`` is a name, several names, or a predicate on ``author_id``.  A parent with
    very many replies is a hot join key, so hot parents are spread.
    """
    replies = _brand_replies(msgs, brand).where(F.col("in_response_to_tweet_id").isNotNull()).select(
        F.col("author_id").alias("brand"),
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        F.col("tweet_id").alias("brand_tweet_id"),
        F.coalesce("created_at", F.lit("")).alias("brand_created_at"),
        F.coalesce("text", F.lit("")).alias("brand_reply_raw"),
    )
    parents = msgs.where(F.col("inbound")).select(
        F.col("tweet_id").alias("customer_tweet_id"),
        F.coalesce("author_id", F.lit("")).alias("customer_author"),
        F.coalesce("created_at", F.lit("")).alias("customer_created_at"),
        F.coalesce("text", F.lit("")).alias("customer_text_raw"),
        F.col("in_response_to_tweet_id").alias("customer_parent_id"),
    )
    return join_to_unique(replies, parents, "customer_tweet_id", ["brand_tweet_id"]).select(
        "brand",
        "customer_tweet_id",
        "customer_author",
        "customer_created_at",
        "customer_text_raw",
        "customer_parent_id",
        "brand_tweet_id",
        "brand_created_at",
        "brand_reply_raw",
    )


def pair_funnel(msgs: DataFrame, brand: str | Sequence[str] | Column) -> DataFrame:
    """What became of every brand message; counted per parent before the join."""
    by_parent = _brand_replies(msgs, brand).groupBy(F.col("in_response_to_tweet_id").alias("parent_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    parents = msgs.select(F.col("tweet_id").alias("parent_id"), F.col("inbound").alias("_inbound"))
    named = F.col("parent_id").isNotNull()

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))

    return by_parent.join(parents, "parent_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("brand_replies"),
        total(F.col("_inbound")).alias("paired"),
        total(named & F.col("_inbound").isNull()).alias("missing_parent"),
        total(named & ~F.col("_inbound")).alias("non_inbound_parent"),
    )


def normalize_pairs(pairs: DataFrame, brand: str | Column | None = None) -> DataFrame:
    """Add the clean texts; without ``brand`` each row's own brand is the one kept."""
    name = F.col("brand") if brand is None else brand
    return pairs.withColumn(
        "customer_text_clean", T.normalize_corpus_text(F.col("customer_text_raw"), name)
    ).withColumn("brand_reply_clean", T.normalize_corpus_text(F.col("brand_reply_raw"), name))


def dedup_keep_earliest(
    pairs: DataFrame,
    text: str = "customer_text_clean",
    order: Sequence[str] = ("customer_tweet_id", "brand_tweet_id"),
) -> DataFrame:
    """Keep the earliest row of each text.

    A ``min_by`` aggregate keeps one row per text in every map task, so even a text that
    fills a third of the table reaches its reducer as one row per task.
    """
    kept = pairs.groupBy(text_digest(F.col(text)).alias("_digest")).agg(
        F.min_by(F.struct(*pairs.columns), F.struct(*order)).alias("_row")
    )
    return kept.select("_row.*")


def dedup_report(pairs: DataFrame, text: str = "customer_text_clean") -> DataFrame:
    """Rows before and after de-duplication."""
    return (
        pairs.groupBy(text_digest(F.col(text)).alias("_digest"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("before"), F.count(F.lit(1)).alias("after"))
        .select(
            "before",
            "after",
            (F.col("before") - F.col("after")).alias("removed"),
            percent(F.col("before") - F.col("after"), F.col("before"), 2).alias("removed_pct"),
        )
    )


def turn_and_length_features(
    pairs: DataFrame, text: str = "customer_text_clean", parent: str = "customer_parent_id"
) -> DataFrame:
    """Character length and whether the message opens its thread."""
    return pairs.withColumn("customer_char_len", F.length(text).cast("bigint")).withColumn(
        "is_first_turn", F.col(parent).isNull() | (F.col(parent).cast("string") == "")
    )


def tercile_bucket(rows: DataFrame, length: str = "customer_char_len") -> DataFrame:
    """Add ``length_bucket`` with edges at the interpolated 1/3 and 2/3 quantiles, right-closed.

    Lengths are counted first, so the exact quantiles come from one small frequency table.
    """
    counts = rows.groupBy(length).agg(F.count(F.lit(1)).alias("n"))
    edges = counts.agg(F.expr(f"percentile({length}, array(1.0D/3, 2.0D/3), n)")).scalar()
    marked = rows.withColumn("_edges", edges)
    return marked.withColumn(
        "length_bucket",
        F.when(F.col(length) <= F.col("_edges")[0], F.lit("short"))
        .when(F.col(length) <= F.col("_edges")[1], F.lit("medium"))
        .otherwise(F.lit("long")),
    ).drop("_edges")


def split_leakage_ids(rows: DataFrame, row_id: str = "customer_tweet_id") -> DataFrame:
    """Number of ids found in more than one split; must be 0.

    One aggregate per id instead of a join of the pools with each other.
    """
    splits = rows.groupBy(row_id).agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return splits.agg(count_if(F.col("a") != F.col("b")).alias("shared_ids"))


def split_leakage_text(
    rows: DataFrame, text: str = "customer_text_clean", keep: str = D.RETRIEVAL_POOL, clean: str = D.EVAL_POOL
) -> DataFrame:
    """Drop rows of the ``clean`` pool whose text also occurs in the ``keep`` pool.

    The pool's texts are reduced to distinct digests first; the rows of ``clean`` with a
    hot text are spread by the join helper.
    """
    digest = text_digest(F.col(text))
    known = rows.where(F.col("split") == keep).select(digest.alias("_digest")).distinct().withColumn("_known", F.lit(True))
    pool = rows.where(F.col("split") == clean).withColumn("_digest", digest)
    spread = [c for c, t in rows.dtypes if t in ("bigint", "int", "string")]
    cleaned = join_to_unique(pool, known, "_digest", spread, how="left").where(F.col("_known").isNull())
    return rows.where(F.col("split") != clean).unionByName(cleaned.select(*rows.columns))


def split_summary(rows: DataFrame) -> DataFrame:
    """Totals by split, turn and length in one aggregate row."""
    is_split, bucket = F.col("split"), F.col("length_bucket")
    return rows.agg(
        F.count(F.lit(1)).alias("total_paired_records"),
        count_if(is_split == D.RETRIEVAL_POOL).alias("retrieval_pool_count"),
        count_if(is_split == D.EVAL_POOL).alias("held_out_eval_pool_count"),
        count_if(F.col("is_first_turn")).alias("first_turn_count"),
        count_if(~F.col("is_first_turn")).alias("follow_up_count"),
        *[count_if(bucket == b).alias(f"{b}_count") for b in ("short", "medium", "long")],
    )


def working_set(
    msgs: DataFrame, brand: str | Sequence[str] | Column, seed: int = D.SPLIT_SEED, share: float = D.RETRIEVAL_SHARE
) -> DataFrame:
    """The whole chain: pairs, clean text, de-duplication, features, split, leakage filter."""
    split = holdout_split(tercile_bucket(clean_pairs(msgs, brand)), "brand_tweet_id", share, seed)
    return split_leakage_text(split)


def clean_pairs(msgs: DataFrame, brand: str | Sequence[str] | Column) -> DataFrame:
    """Clean, de-duplicated pairs with their features.

    Quantiles, split and leakage filter each read them again, so they are written once.
    """
    return materialise(
        turn_and_length_features(dedup_keep_earliest(normalize_pairs(reply_pairs(msgs, brand)))), "pairs"
    )


def corpus_build(
    rows: DataFrame,
    max_records: int | None = None,
    seed: int = D.SPLIT_SEED,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Retrieval corpus from the retrieval pool: case id, texts and any ``extra`` columns.

    The whole pool is kept, unless ``max_records`` asks for a seeded sample.
    """
    pool = split_filter(rows, D.RETRIEVAL_POOL)
    if max_records is not None:
        pool = take_seeded(pool, max_records, seed, "customer_tweet_id")
    return pool.select(
        F.col("customer_tweet_id").alias("case_id"),
        F.col("customer_text_clean").alias("customer_text"),
        F.col("brand_reply_clean").alias("brand_resolution"),
        "brand_tweet_id",
        *extra,
    )
