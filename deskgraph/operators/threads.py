"""Message features and bounded conversation context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T

TURN_TYPE = "array<struct<role:string,text:string,tweet_id:bigint,created_at:string>>"
CHUNK = 10_000


def message_features(rows: DataFrame, text: str = "text", brand: str = D.BRAND_HANDLE) -> DataFrame:
    """Add ``raw_text, clean_text, char_length, word_count, is_ascii``."""
    clean = F.col("clean_text")
    return (
        rows.withColumn("raw_text", F.col(text))
        .withColumn("clean_text", T.normalize_message(F.col(text), brand))
        .withColumn("char_length", F.length(clean).cast("bigint"))
        .withColumn("word_count", F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " "))).cast("bigint"))
        .withColumn("is_ascii", T.is_ascii(clean))
    )


def _turn(role: Column, text: Column, tweet_id: Column, created_at: Column) -> Column:
    return F.struct(
        F.coalesce(role, F.lit("customer")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
        tweet_id.cast("bigint").alias("tweet_id"),
        created_at.cast("string").alias("created_at"),
    )


def last_turns(turns: Column, n: int = D.CONTEXT_TURNS) -> Column:
    """The last ``n`` entries of an array of turns; null counts as none."""
    given = F.coalesce(turns, F.array().cast(TURN_TYPE))
    return F.slice(given, F.greatest(F.lit(1), F.size(given) - n + 1), n)


def bounded_context(
    rows: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    tweet_id: str | None = None,
    created_at: str | None = None,
    n: int = D.CONTEXT_TURNS,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``prior_turns``, the last ``n`` earlier turns of the same conversation, and ``total_turns``.

    Windows run inside (conversation, chunk of ``order``), so a conversation of any length is
    split over tasks.  Only the first ``n`` rows of a later chunk need turns from before it;
    they get the last ``n`` turns carried over from the chunks ahead, which are computed
    just for conversations that reach a second chunk.
    """
    none = F.lit(None)
    turn = _turn(
        F.col(role), F.col(text), F.col(tweet_id) if tweet_id else none, F.col(created_at) if created_at else none
    )
    chunked = rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    inside = Window.partitionBy(conversation, "_chunk").orderBy(order)
    local = chunked.withColumn("_near", F.collect_list(turn).over(inside.rowsBetween(-n, -1))).withColumn(
        "_rank", F.row_number().over(inside)
    )

    long_ones = chunked.groupBy(conversation).agg(
        F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last")
    ).where(F.col("_first") < F.col("_last")).select(conversation)
    backwards = Window.partitionBy(conversation, "_chunk").orderBy(F.desc(order))
    tails = (
        chunked.join(long_ones, conversation, "left_semi")
        .withColumn("_back", F.row_number().over(backwards))
        .where(F.col("_back") <= n)
        .groupBy(conversation, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), turn.alias("t")))).alias("_tail"))
    )
    ahead = Window.partitionBy(conversation).orderBy("_chunk").rowsBetween(-n, -1)
    carried = tails.select(
        conversation,
        "_chunk",
        F.transform(F.flatten(F.collect_list("_tail").over(ahead)), lambda e: e["t"]).alias("_carried"),
    )
    joined = local.join(carried, [conversation, "_chunk"], "left")
    prior = F.when(
        (F.col("_rank") <= n) & F.col("_carried").isNotNull(),
        last_turns(F.concat(F.col("_carried"), F.col("_near")), n),
    ).otherwise(F.col("_near"))
    return joined.withColumn("prior_turns", prior).withColumn(
        "total_turns", (F.size("prior_turns") + 1).cast("bigint")
    ).select(*rows.columns, "prior_turns", "total_turns")


def thread_transcript(prior_turns: Column, current: Column) -> Column:
    """Readable transcript: one line per prior turn, then the current message."""
    lines = F.transform(
        F.coalesce(prior_turns, F.array().cast(TURN_TYPE)),
        lambda t: F.concat(
            F.when(t["role"] == "customer", F.lit("Customer: ")).otherwise(F.lit("Support Agent: ")), t["text"]
        ),
    )
    last = F.concat(F.lit("Customer (Current): "), current)
    return F.array_join(F.concat(lines, F.array(last)), "\n")


def turn_position(prior_turns: Column) -> Column:
    return F.when(F.coalesce(F.size(prior_turns), F.lit(0)) > 0, F.lit("follow_up")).otherwise(F.lit("first_turn"))
