"""The whole scoring of a message as one chain of DataFrame steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions import text as T
from deskgraph.operators import grounding, intent, replies, retrieval, routing, threads
from deskgraph.operators.case_index import CaseIndex
from deskgraph.operators.vectors import Centroids, usable_vector
from deskgraph.session import materialise
from deskgraph.sources import writers
from deskgraph.sources.snapshots import Snapshots

OUTPUT = (
    "execution_id",
    "example_id",
    "input_text",
    "clean_text",
    "turn_position",
    "predicted_intent",
    "intent_confidence",
    "retrieved_case_ids",
    "max_retrieval_similarity",
    "generated_reply",
    "grounding_pass",
    "grounding_score",
    "routing_decision",
    "routing_reason",
    "composite_confidence",
    "latency_ms",
    "error",
)


@dataclass(frozen=True)
class ScoringSettings:
    brand: str = D.BRAND_HANDLE
    top_k: int = D.TOP_K
    intent_threshold: float = D.INTENT_THRESHOLD
    policy: routing.RoutingPolicy = routing.RoutingPolicy()


def invalid_reason(columns: Sequence[str] = ("input_text", "embedding"), width: int | None = None):
    """Text of the first input that is missing or a vector of no use, null for a usable row."""
    checks = [(F.col(c).isNull(), F.lit(f"missing {c}")) for c in columns]
    if "embedding" in columns:
        checks.append((~usable_vector("embedding", width), F.lit("unusable embedding")))
    chain = F.when(*checks[0])
    for check in checks[1:]:
        chain = chain.when(*check)
    return chain


def score_messages(
    messages: DataFrame, model: Centroids, corpus: DataFrame | CaseIndex, settings: ScoringSettings | None = None
) -> DataFrame:
    """Score ``messages(example_id, input_text, prior_turns, edge_category, embedding)``.

    ``corpus`` is a stored index with its cases, or holds ``case_id, customer_text, brand_resolution, embedding``.  A row without text
    or usable vector becomes an error row instead of failing the job.  The shuffles are those of
    the case search; everything else is narrow.
    """
    s = settings or ScoringSettings()
    checked = messages.withColumn("error", invalid_reason(width=model.values.shape[1])).withColumn(
        "clean_text", T.normalize_message(F.col("input_text"), s.brand)
    )
    checked = materialise(checked, "checked")  # read by the search, the classifier and the error rows
    usable = checked.where(F.col("error").isNull())

    found = retrieval.topk_similar_cases(
        usable, corpus, s.top_k, query_id="example_id", text="clean_text", width=model.values.shape[1]
    )
    labelled = intent.nearest_centroid_classify(
        usable, model, text="clean_text", threshold=s.intent_threshold
    )
    with_cases = retrieval.with_evidence(labelled.drop("max_similarity", "embedding"), found, "example_id")
    replied = with_cases.withColumn(
        "generated_reply", replies.grounded_template_reply(F.col("best_resolution"), F.col("intent"))
    )
    audited = grounding.grounding_verdict(replied)
    routed = routing.route_decision(
        audited, s.policy, similarity="max_similarity", category="edge_category", text="input_text"
    )
    done = routed.select(
        routing.execution_id(F.col("example_id")).alias("execution_id"),
        "example_id",
        "input_text",
        "clean_text",
        threads.turn_position(F.col("prior_turns")).alias("turn_position"),
        F.col("intent").alias("predicted_intent"),
        "intent_confidence",
        "retrieved_case_ids",
        F.col("max_similarity").alias("max_retrieval_similarity"),
        "generated_reply",
        "grounding_pass",
        "grounding_score",
        "routing_decision",
        "routing_reason",
        "composite_confidence",
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit(None).cast("string").alias("error"),
    )
    return done.unionByName(error_rows(checked.where(F.col("error").isNotNull())))


def error_rows(failed: DataFrame) -> DataFrame:
    """Output rows of messages that could not be scored: other, zero scores, escalate, and why."""
    return failed.select(
        routing.execution_id(F.col("example_id")).alias("execution_id"),
        "example_id",
        "input_text",
        F.col("input_text").alias("clean_text"),
        F.lit("first_turn").alias("turn_position"),
        F.lit(D.OTHER_INTENT).alias("predicted_intent"),
        F.lit(0.0).alias("intent_confidence"),
        F.array().cast("array<bigint>").alias("retrieved_case_ids"),
        F.lit(0.0).alias("max_retrieval_similarity"),
        F.lit(D.ERROR_REPLY).alias("generated_reply"),
        F.lit(False).alias("grounding_pass"),
        F.lit(0.0).alias("grounding_score"),
        F.lit("ESCALATE").alias("routing_decision"),
        F.concat(F.lit(D.ERROR_REASON), F.col("error")).alias("routing_reason"),
        F.lit(0.0).alias("composite_confidence"),
        F.lit(None).cast("double").alias("latency_ms"),
        "error",
    )


def with_cached_predictions(gold: DataFrame, cache: DataFrame | Snapshots, score) -> DataFrame:
    """Stored predictions where the id has one; ``score`` is called on the remaining rows only.

    Both sides are unique by id.  A ``cache`` of snapshots gets what was scored as a new version, so that a second call
    scores nothing; if scoring or writing fails, the version before stays the one that counts.
    """
    if isinstance(cache, Snapshots):
        return _with_write_back(gold, cache, score)
    hits = cache.join(gold.select("example_id"), "example_id", "left_semi")
    misses = gold.join(cache.select("example_id"), "example_id", "left_anti")
    scored = score(misses)
    return hits.select(*scored.columns, F.lit(True).alias("cached")).unionByName(
        scored.withColumn("cached", F.lit(False))
    )


def _with_write_back(gold: DataFrame, store: Snapshots, score) -> DataFrame:
    version = max(store.versions(), default=0)
    held = store.read(version) if version else None
    misses = gold if held is None else gold.join(held.select("example_id"), "example_id", "left_anti")
    misses = materialise(misses, "to-score")
    fresh = None
    if not misses.isEmpty():
        fresh = materialise(score(misses), "scored")
        store.write(fresh if held is None else writers.merged_predictions(held, fresh), after=version)
    parts = [] if fresh is None else [fresh.withColumn("cached", F.lit(False))]
    if held is not None:
        parts.append(held.join(gold.select("example_id"), "example_id", "left_semi").withColumn("cached", F.lit(True)))
    if not parts:  # nothing stored and nothing asked
        return score(misses).withColumn("cached", F.lit(False))
    return reduce(DataFrame.unionByName, parts)
