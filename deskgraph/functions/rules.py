"""Ordered keyword and threshold rules as single CASE expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """Value of the first rule that holds."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def lookup(key: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Value of ``key`` in a small fixed table, folded into the expression: no join, nothing to broadcast."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def keyword_first_match(
    text: Column,
    patterns: Mapping[str, str] = D.INTENT_PATTERNS,
    other: str = D.OTHER_INTENT,
) -> Column:
    """Label of the first pattern, in order, that occurs in ``text``."""
    return first_match([(T.matches(text, p), F.lit(label)) for label, p in patterns.items()], F.lit(other))


def edge_category(
    text: Column,
    safety: str = D.SAFETY_PATTERN,
    sarcasm: str = D.SARCASM_PATTERN,
    low_info: str = D.LOW_INFO_PATTERN,
    low_info_words: int = D.LOW_INFO_WORDS,
) -> Column:
    """Safety, then sarcasm, then low information (pattern or very few words), else standard."""
    return first_match(
        [
            (T.matches(text, safety), F.lit(D.SAFETY_CATEGORY)),
            (T.matches(text, sarcasm), F.lit(D.SARCASM_CATEGORY)),
            (T.matches(text, low_info) | (T.word_count(text) <= low_info_words), F.lit(D.LOW_INFO_CATEGORY)),
        ],
        F.lit(D.STANDARD_CATEGORY),
    )


def safety_trigger(
    text: Column,
    category: Column,
    words: Sequence[str] = D.SAFETY_WORDS,
    whole_word: bool = False,
) -> Column:
    """Safety category, or a safety word anywhere in the text.

    By default words count as substrings, so "issue" fires on "sue"; ``whole_word`` is stricter.
    """
    if whole_word:
        hit = T.matches(text, r"\b(" + "|".join(words) + r")\b")
    else:
        hit = T.contains_any(F.lower(text), words)
    return F.coalesce(category == D.SAFETY_CATEGORY, F.lit(False)) | hit


def keyword_hits(text: Column, keywords: Sequence[str] = D.ESCALATION_KEYWORDS) -> Column:
    """Sorted distinct keywords among the lower-cased white-space tokens."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{T.SPACE}]+")
    return F.array_intersect(F.array(*[F.lit(k) for k in sorted(keywords)]), parts)


def keyword_escalation(rows: DataFrame, text: str, keywords: Sequence[str] = D.ESCALATION_KEYWORDS) -> DataFrame:
    """Add ``routing_decision`` and ``routing_reason`` of the keyword-only router."""
    hits = F.col("_hits")
    found = F.size(hits) > 0
    return (
        rows.withColumn("_hits", keyword_hits(F.col(text), keywords))
        .withColumn("routing_decision", F.when(found, F.lit("escalate")).otherwise(F.lit("auto_handle")))
        .withColumn(
            "routing_reason",
            F.when(found, F.concat(F.lit(D.KEYWORD_REASON), F.array_join(hits, ", "))).otherwise(F.lit(D.NO_KEYWORD_REASON)),
        )
        .drop("_hits")
    )
