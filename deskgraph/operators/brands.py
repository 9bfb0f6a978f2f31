"""Score and rank support accounts on volume, completeness, diversity, language and substance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T
from deskgraph.functions.numeric import count_if, percent, round_dp
from deskgraph.operators.skew import join_to_unique, top_n_per_group
from deskgraph.session import materialise

CANDIDATES = 10


def brand_candidates(msgs: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The ``n`` authors with most outbound messages."""
    return (
        msgs.where(~F.col("inbound"))
        .groupBy(F.col("author_id").alias("brand"))
        .agg(F.count(F.lit(1)).alias("outbound_replies"))
        .orderBy(F.desc("outbound_replies"), "brand")
        .limit(n)
    )


def _candidate_messages(msgs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Messages by the candidates.  The names are literals, so the scan itself filters on them."""
    return msgs.where(F.col("author_id").isin(*names)).withColumnRenamed("author_id", "brand")


def candidate_names(candidates: DataFrame) -> list[str]:
    """The names of a candidate table, which is as short as its ``limit``."""
    return [row["brand"] for row in candidates.select("brand").collect()]


def _inbound_ids(msgs: DataFrame) -> DataFrame:
    return msgs.where(F.col("inbound")).select(F.col("tweet_id").alias("parent_id"))


def brand_usable_volume(msgs: DataFrame, candidates: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Replies whose parent exists and is inbound.

    Replies are counted per (brand, parent) before the join, so a message with very
    many replies is one row when it meets its parent.
    """
    replies = (
        _candidate_messages(msgs, candidate_names(candidates) if names is None else names)
        .where(F.col("in_response_to_tweet_id").isNotNull())
        .groupBy("brand", F.col("in_response_to_tweet_id").alias("parent_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    usable = replies.join(_inbound_ids(msgs), "parent_id").groupBy("brand").agg(F.sum("n").alias("usable"))
    return candidates.join(usable, "brand", "left").select(
        "brand",
        "outbound_replies",
        F.coalesce("usable", F.lit(0).cast("bigint")).alias("usable_inbound_volume"),
    )


def thread_completeness(volumes: DataFrame) -> DataFrame:
    """Usable volume as percentage of all messages of the brand."""
    return volumes.withColumn(
        "thread_completeness_pct", percent(F.col("usable_inbound_volume"), F.col("outbound_replies"), 1)
    )


def customer_texts(msgs: DataFrame, names: Sequence[str], cap: int | None = None) -> DataFrame:
    """Customer texts behind the usable replies of each candidate: ``brand, n, text``, ``n`` giving their order.

    All of them come from one join with the parents.  With ``cap`` only the first of each candidate
    are kept: ids travel until the cut is made, and the chosen parents' texts are fetched afterwards.
    """
    if cap is None:
        replies = _candidate_messages(msgs, names).where(F.col("in_response_to_tweet_id").isNotNull())
        parents = msgs.where(F.col("inbound")).select(F.col("tweet_id").alias("parent_id"), "text")
        asked = replies.select("brand", F.col("tweet_id").alias("n"), F.col("in_response_to_tweet_id").alias("parent_id"))
        return join_to_unique(asked, parents, "parent_id", ["n"]).select("brand", "n", "text")
    replies = _candidate_messages(msgs, names).select(
        "brand", "tweet_id", F.col("in_response_to_tweet_id").alias("parent_id")
    )
    usable = join_to_unique(
        replies.where(F.col("parent_id").isNotNull()), _inbound_ids(msgs), "parent_id", ["tweet_id"]
    )
    chosen = top_n_per_group(usable, ["brand"], [F.col("tweet_id")], cap, rank="n", spread_by=["tweet_id"])
    texts = msgs.select(F.col("tweet_id").alias("parent_id"), "text")
    return chosen.join(texts, "parent_id").select("brand", "n", "text")


def first_replies(msgs: DataFrame, names: Sequence[str], cap: int | None = None) -> DataFrame:
    """The messages of each candidate, or the first ``cap`` of them: ``brand, text``."""
    if cap is None:
        return _candidate_messages(msgs, names).select("brand", "text")
    ids = _candidate_messages(msgs, names).select("brand", "tweet_id")
    chosen = top_n_per_group(ids, ["brand"], [F.col("tweet_id")], cap, spread_by=["tweet_id"])
    return chosen.join(msgs.select("tweet_id", "text"), "tweet_id").select("brand", "text")


def lexical_entropy(
    texts: DataFrame,
    group: str = "brand",
    text: str = "text",
    order: str = "n",
    cap: int | None = None,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Word entropy over log2 of the vocabulary, per group; 0.0 for a group without words.

    All texts count.  ``cap`` keeps the first texts of each group in ``order`` instead.  Give
    ``spread_by`` when a group may be large before the cut.
    """
    kept = texts.where(F.col(text).isNotNull())
    if cap is not None:
        kept = top_n_per_group(kept.select(group, order, text), [group], [F.col(order)], cap, spread_by=spread_by)
    counts = (
        kept.select(group, F.explode_outer(T.words(F.lower(F.col(text)), "[a-z]{3,}")).alias("word"))
        .groupBy(group, "word")
        .agg(F.count("word").alias("n"))
    )
    # -sum(p log2 p) with p = n/N equals log2 N - sum(n log2 n)/N: one pass over the counts.
    used = F.when(F.col("n") > 0, F.col("n"))
    sums = counts.groupBy(group).agg(
        F.sum(used).cast("double").alias("total"),
        F.sum(used * F.log2(used)).alias("weighted"),
        F.count(used).cast("double").alias("distinct"),
    )
    entropy = F.log2("total") - F.col("weighted") / F.col("total")
    top = F.when(F.col("distinct") > 1, F.log2("distinct")).otherwise(F.lit(1.0))
    return sums.select(group, F.coalesce(round_dp(entropy / top, 4), F.lit(0.0)).alias("lexical_entropy"))


def ascii_homogeneity(texts: DataFrame, group: str = "brand", text: str = "text") -> DataFrame:
    """Percentage of texts made of ASCII only."""
    return texts.groupBy(group).agg(
        percent(count_if(T.is_ascii(F.col(text))), F.count(F.lit(1)), 1).alias("ascii_pct")
    )


def resolution_substance(replies: DataFrame, group: str = "brand", text: str = "text") -> DataFrame:
    """Mean length, and percentage of long replies that are not a bare greeting."""
    body = F.lower(F.col(text))
    substantive = (F.length(text) > D.SUBSTANTIVE_LENGTH) & ~T.matches(body, D.GREETING_PATTERN, ignore_case=False)
    return replies.groupBy(group).agg(
        round_dp(F.avg(F.length(text)), 1).alias("avg_reply_length"),
        percent(count_if(substantive), F.count(F.lit(1)), 1).alias("substantive_pct"),
    )


def brand_composite(scores: DataFrame, weights: dict[str, float] | None = None, volume_cap: float = D.VOLUME_CAP) -> DataFrame:
    """Weighted sum of the five scores, each scaled to at most 1."""
    w = weights or D.BRAND_WEIGHTS
    one = F.lit(1.0)
    return scores.withColumn(
        "composite_score",
        round_dp(
            F.lit(w["volume"]) * F.least(one, F.col("usable_inbound_volume") / F.lit(volume_cap))
            + F.lit(w["completeness"]) * F.least(one, F.col("thread_completeness_pct") / F.lit(100.0))
            + F.lit(w["entropy"]) * F.col("lexical_entropy")
            + F.lit(w["ascii"]) * F.least(one, F.col("ascii_pct") / F.lit(100.0))
            + F.lit(w["substance"]) * F.least(one, F.col("substantive_pct") / F.lit(100.0)),
            4,
        ),
    )


def brand_scores(
    msgs: DataFrame, n: int = CANDIDATES, cap: int | None = None, entropy_cap: int | None = None
) -> DataFrame:
    """All scores of the top ``n`` brands over all their texts, one row each.

    The candidates and their texts are written once since several scores read them.  The two caps
    score only the first texts of each brand, as a quick look does.
    """
    candidates = materialise(brand_candidates(msgs, n), "candidates")
    names = candidate_names(candidates)
    texts = materialise(customer_texts(msgs, names, cap), "brand-texts")
    scored = (
        thread_completeness(brand_usable_volume(msgs, candidates, names))
        .join(lexical_entropy(texts, cap=entropy_cap), "brand", "left")
        .join(ascii_homogeneity(texts), "brand", "left")
        .join(resolution_substance(first_replies(msgs, names, cap)), "brand", "left")
        .na.fill(0.0, ["lexical_entropy", "ascii_pct", "avg_reply_length", "substantive_pct"])
    )
    return brand_composite(scored)


def brand_ranking(scores: DataFrame) -> DataFrame:
    """Rank of every candidate with the winner and runner-up; the input is one row per candidate."""
    order = Window.orderBy(F.desc("composite_score"), "brand")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return scores.select(
        F.row_number().over(order).cast("bigint").alias("rank"),
        "brand",
        "composite_score",
        F.first("brand").over(whole).alias("winner"),
        F.nth_value("brand", 2).over(whole).alias("runner_up"),
    )


