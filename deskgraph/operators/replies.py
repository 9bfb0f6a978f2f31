"""Replies from caches, templates and policies, and prompt rows for an outside model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T
from deskgraph.functions.rules import lookup
from deskgraph.operators.skew import join_to_unique


def prompt_rows(
    rows: DataFrame,
    template: str,
    columns: Sequence[str],
    name: str = "prompt",
    strip: bool = False,
    when_blank: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add a prompt: a ``printf`` template filled from string columns.

    Serves generation, audit and rating prompts alike.  ``strip`` trims every value and
    ``when_blank`` names a stand-in for blank columns.
    """
    blanks = when_blank or {}

    def part(column: str) -> Column:
        text = F.coalesce(F.col(column), F.lit(""))
        text = T.strip(text) if strip else text
        return F.when(T.is_blank(text), F.lit(blanks[column])).otherwise(text) if column in blanks else text

    return rows.withColumn(name, F.format_string(template, *[part(c) for c in columns]))


def reply_key(message: Column, version: str = D.PROMPT_VERSION) -> Column:
    return F.concat(F.lit("reply_"), F.md5(F.concat(message, F.lit(version)).cast("binary")))


def reply_cache_join(
    rows: DataFrame,
    cache: DataFrame,
    row_id: str,
    message: str = "clean_text",
    case_ids: str = "retrieved_case_ids",
    version: str = D.PROMPT_VERSION,
) -> DataFrame:
    """Add ``cache_key, reply_text, evidence_ids_used, cached`` from ``cache(cache_key, reply_text, evidence_ids_used)``.

    A much repeated message is a hot key; it is spread over the row id.
    """
    keyed = rows.withColumn("cache_key", reply_key(F.col(message), version))
    stored = cache.select(
        "cache_key", "reply_text", F.col("evidence_ids_used").alias("_ids"), F.lit(True).alias("_hit")
    )
    joined = join_to_unique(keyed, stored, "cache_key", [row_id], how="left")
    return joined.select(
        *rows.columns,
        "cache_key",
        "reply_text",
        F.coalesce("_ids", case_ids).alias("evidence_ids_used"),
        F.coalesce("_hit", F.lit(False)).alias("cached"),
    )


def reply_cache_misses(rows: DataFrame, cache: DataFrame, message: str = "clean_text", version: str = D.PROMPT_VERSION) -> DataFrame:
    """Distinct keys that still need a reply, with the message to answer."""
    needed = rows.select(reply_key(F.col(message), version).alias("cache_key"), message).groupBy("cache_key").agg(
        F.min(message).alias(message)
    )
    return needed.join(cache.select("cache_key"), "cache_key", "left_anti")


def short_reply_fallback(reply: Column) -> Column:
    """Safety template for a reply that is too short, generic template for none at all."""
    stripped = T.strip(reply)
    return F.coalesce(
        F.when(F.length(stripped) < D.SHORT_REPLY, F.lit(D.SHORT_REPLY_TEMPLATE)).otherwise(stripped),
        F.lit(D.NO_REPLY_TEMPLATE),
    )


def grounded_template_reply(
    best_resolution: Column,
    intent: Column,
    policies: Mapping[str, str] = D.REPLY_POLICIES,
    other: str = D.OTHER_INTENT,
) -> Column:
    """The best case's reply without its old handle, or the policy of the intent."""
    clean = T.strip(F.replace(best_resolution, F.lit("@customer"), F.lit("")))
    usable = (F.length(clean) > D.TEMPLATE_MIN_LENGTH) & ~F.startswith(clean, F.lit("http"))
    return F.when(usable, F.concat(F.lit("Hi there. "), clean)).otherwise(lookup(intent, policies, policies[other]))


def canned_reply(
    intent: Column, templates: Mapping[str, str] = D.CANNED_REPLIES, default: str = D.CANNED_DEFAULT
) -> Column:
    """Fixed reply of the intent."""
    return lookup(intent, templates, default)
