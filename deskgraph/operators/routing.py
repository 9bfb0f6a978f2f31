"""Composite confidence and the automatic-or-human decision."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions.numeric import fixed, round_dp
from deskgraph.functions.rules import first_match, safety_trigger


@dataclass(frozen=True)
class RoutingPolicy:
    """Thresholds, weights and word lists of the router."""

    auto_handle_threshold: float = D.AUTO_HANDLE_THRESHOLD
    min_retrieval_similarity: float = D.MIN_RETRIEVAL_SIMILARITY
    min_grounding_score: float = D.MIN_GROUNDING_SCORE
    weights: dict[str, float] = field(default_factory=lambda: dict(D.ROUTING_WEIGHTS))
    mandatory_intents: Sequence[str] = D.MANDATORY_INTENTS
    safety_words: Sequence[str] = D.SAFETY_WORDS
    whole_word: bool = False


def composite_confidence(
    intent: Column, retrieval: Column, grounding: Column, weights: dict[str, float] | None = None
) -> Column:
    """Weighted sum of the three scores, 4 places."""
    w = weights or D.ROUTING_WEIGHTS
    return round_dp(
        F.lit(w["intent"]) * intent + F.lit(w["retrieval"]) * retrieval + F.lit(w["grounding"]) * grounding, 4
    )


def route_decision(
    rows: DataFrame,
    policy: RoutingPolicy | None = None,
    intent: str = "intent",
    intent_confidence: str = "intent_confidence",
    similarity: str = "retrieval_similarity",
    grounding_pass: str = "grounding_pass",
    grounding_score: str = "grounding_score",
    category: Column | str = "edge_case_category",
    text: str = "raw_text",
) -> DataFrame:
    """Add ``routing_decision, action, routing_reason, triggered_rules, composite_confidence``.

    The first rule that holds decides, in one CASE over a rule name, so that decision, reason and
    rule cannot disagree.
    """
    p = policy or RoutingPolicy()
    edge = F.col(category) if isinstance(category, str) else category
    conf, sim, score = F.col(intent_confidence), F.col(similarity), F.col(grounding_score)
    ruled = rows.withColumn(
        "composite_confidence", composite_confidence(conf, sim, score, p.weights)
    ).withColumn(
        "_rule",
        first_match(
            [
                (safety_trigger(F.coalesce(F.col(text), F.lit("")), edge, p.safety_words, p.whole_word), F.lit(D.RULE_SAFETY)),
                (F.col(intent).isin(*p.mandatory_intents), F.lit(D.RULE_INTENT)),
                (~F.col(grounding_pass) | (score < F.lit(p.min_grounding_score)), F.lit(D.RULE_GROUNDING)),
                (sim < F.lit(p.min_retrieval_similarity), F.lit(D.RULE_SIMILARITY)),
                (F.col("composite_confidence") >= F.lit(p.auto_handle_threshold), F.lit(D.RULE_AUTO)),
            ],
            F.lit(D.RULE_COMPOSITE),
        ),
    )
    rule = F.col("_rule")
    reason = first_match(
        [
            (rule == D.RULE_SAFETY, F.lit(D.REASON_SAFETY)),
            (rule == D.RULE_INTENT, F.format_string(D.REASON_INTENT, F.col(intent))),
            (rule == D.RULE_GROUNDING, F.format_string(D.REASON_GROUNDING.format(minimum=p.min_grounding_score), fixed(score, 2))),
            (rule == D.RULE_SIMILARITY, F.format_string(D.REASON_SIMILARITY.format(minimum=p.min_retrieval_similarity), fixed(sim, 2))),
            (rule == D.RULE_AUTO, F.format_string(D.REASON_AUTO, fixed(conf, 2), fixed(sim, 2), fixed(score, 2))),
        ],
        F.format_string(D.REASON_COMPOSITE.format(minimum=p.auto_handle_threshold), fixed(F.col("composite_confidence"), 2)),
    )
    decision = F.when(rule == D.RULE_AUTO, F.lit("AUTO_HANDLE")).otherwise(F.lit("ESCALATE"))
    named = F.when(rule == D.RULE_INTENT, F.concat(rule, F.upper(F.col(intent)))).otherwise(rule)
    return ruled.select(
        *rows.columns,
        decision.alias("routing_decision"),
        F.lower(decision).alias("action"),
        reason.alias("routing_reason"),
        F.array(named).alias("triggered_rules"),
        "composite_confidence",
    )


def execution_id(example_id: Column) -> Column:
    """Deterministic id of one execution."""
    return F.concat(F.lit("exec_"), F.substring(F.md5(example_id.cast("string").cast("binary")), 1, 8))
