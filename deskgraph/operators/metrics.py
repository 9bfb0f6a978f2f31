"""Evaluation metrics of any number of systems at once.

Every function takes the rows of :func:`prediction_gold_join` and groups by ``by``
(``system_name`` unless told otherwise).  Groups hold aggregates only, so a system with
most of the rows is reduced in its map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions.numeric import count_if, harmonic, ratio, round_dp
from deskgraph.session import materialise

SYSTEM = ("system_name",)


#: Size of a latency sketch, and how far the rank of its quantiles may be from the one asked for.
SKETCH_K = 400
SKETCH_ERROR = 0.01


def _lower_action(*columns: str) -> Column:
    return F.lower(F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns], F.lit("")))


def prediction_gold_join(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with their gold labels; unmatched predictions drop out, missing fields get defaults."""

    def has(frame: DataFrame, name: str, default: object) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in frame.columns else F.lit(default)

    actions = [c for c in ("gold_routing_decision", "gold_action") if c in gold.columns]
    edges = [F.when(F.col(c) != "", F.col(c)) for c in ("edge_case_category", "edge_category") if c in gold.columns]
    truth = gold.select(
        F.col("example_id").cast("string").alias("example_id"),
        F.coalesce("gold_intent", F.lit("")).alias("true_intent"),
        _lower_action(*actions).alias("true_action"),
        F.coalesce(*edges, F.lit(D.STANDARD_CATEGORY)).alias("edge_category"),
    )
    found = preds.select(
        F.col("system_name"),
        F.col("example_id").cast("string").alias("example_id"),
        has(preds, "predicted_intent", "").alias("pred_intent"),
        F.lower(has(preds, "routing_decision", "")).alias("pred_action"),
        has(preds, "grounding_pass", True).alias("grounding_pass"),
        has(preds, "grounding_score", 1.0).cast("double").alias("grounding_score"),
        has(preds, "latency_ms", 0.0).cast("double").alias("latency_ms"),
    )
    return found.join(truth, "example_id")


def _confusion(joined: DataFrame, by: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """One row per pair of true and predicted label."""
    return joined.groupBy(*by, "true_intent", "pred_intent").agg(F.count(F.lit(1)).alias("n"), *extra)


def _label_counts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """True positives, predicted and true rows of every label that occurs on either side."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("true_intent") == F.col("pred_intent"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("true_intent").alias("label"), F.col("n").alias("t"), zero.alias("p"), hit.alias("tp")),
        F.struct(F.col("pred_intent").alias("label"), zero.alias("t"), F.col("n").alias("p"), zero.alias("tp")),
    )
    return (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    )


def _precision() -> Column:
    return ratio(F.col("tp"), F.col("predicted"))


def _recall() -> Column:
    return ratio(F.col("tp"), F.col("support"))


def _f1() -> Column:
    return ratio(F.lit(2.0) * F.col("tp"), F.col("support") + F.col("predicted"))


def per_class_prf(joined: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Precision, recall, F1 and support of every label."""
    return _label_counts(_confusion(joined, by), by).select(
        *by,
        "label",
        round_dp(_precision(), 4).alias("precision"),
        round_dp(_recall(), 4).alias("recall"),
        round_dp(_f1(), 4).alias("f1"),
        "support",
    )


def intent_accuracy_macro_f1(joined: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Accuracy, and the plain mean of F1 over every label seen in truth or prediction."""
    return _accuracy_macro_f1(_confusion(joined, by), by)


def _accuracy_macro_f1(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return _label_counts(cells, by).groupBy(*by).agg(
        round_dp(ratio(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
        round_dp(F.avg(_f1()), 4).alias("macro_f1"),
    )


def _escalation_counts(prefix: str = "") -> list[Column]:
    t, p = F.col("true_action") == "escalate", F.col("pred_action") == "escalate"
    return [
        count_if(t & p).alias(f"{prefix}tp"),
        count_if(~t & p).alias(f"{prefix}fp"),
        count_if(t & ~p).alias(f"{prefix}fn"),
        count_if(~t & ~p).alias(f"{prefix}tn"),
    ]


def _escalation_scores() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": round_dp(ratio(tp + tn, tp + fp + fn + tn), 4),
        "precision": round_dp(precision, 4),
        "recall": round_dp(recall, 4),
        "f1": round_dp(harmonic(precision, recall), 4),
    }


def escalation_confusion(joined: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Confusion counts and scores with escalation as the positive class."""
    scores = [c.alias(n) for n, c in _escalation_scores().items()]
    return joined.groupBy(*by).agg(*_escalation_counts()).select(*by, *scores, "tp", "fp", "fn", "tn")


def _autonomy_counts() -> list[Column]:
    auto = F.col("pred_action") == "auto_handle"
    return [
        count_if(auto).alias("auto_handle_count"),
        count_if(auto & (F.col("true_action") == "auto_handle")).alias("_valid"),
    ]


def _autonomy_scores() -> list[Column]:
    total, valid = F.col("auto_handle_count"), F.col("_valid")
    return [
        total,
        F.when(total > 0, valid).alias("valid_resolvable_count"),
        F.when(total > 0, total - valid).alias("unsafe_auto_handled_count"),
        round_dp(ratio(valid, total), 4).alias("autonomy_resolvability_rate"),
    ]


def autonomy_resolvability(joined: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Of the rows handled automatically, how many gold also handles so; nulls where there are none."""
    return joined.groupBy(*by).agg(*_autonomy_counts()).select(*by, *_autonomy_scores())


def _grounding_scores() -> list[Column]:
    return [
        round_dp(ratio(count_if(F.col("grounding_pass")), F.count(F.lit(1))), 4).alias("grounding_pass_rate"),
        round_dp(F.coalesce(F.avg("grounding_score"), F.lit(0.0)), 4).alias("mean_grounding_score"),
    ]


def grounding_rate(joined: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Pass rate and mean score.  Without ``by`` an empty input gives one row of zeros."""
    return joined.groupBy(*by).agg(*_grounding_scores())


def latency_percentiles(joined: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Mean, median and 95th percentile by linear interpolation.

    Latencies are rounded to 1/100 ms and equal values counted first, so the exact percentile sees
    one entry per distinct value, whose number follows the longest latency and not the rows.
    """
    counts = joined.groupBy(*by, round_dp(F.col("latency_ms"), 2).alias("_ms")).agg(F.count(F.lit(1)).alias("_n"))
    packed = counts.groupBy(*by).agg(
        (F.sum(F.col("_ms") * F.col("_n")) / F.sum("_n")).alias("_mean"),
        F.expr("percentile(_ms, array(0.5D, 0.95D), _n)").alias("_p"),
    )
    return packed.select(
        *by,
        round_dp(F.col("_mean"), 2).alias("mean_ms"),
        round_dp(F.col("_p")[0], 2).alias("p50_ms"),
        round_dp(F.col("_p")[1], 2).alias("p95_ms"),
    )


def latency_sketches(joined: DataFrame, by: Sequence[str] = (*SYSTEM, "run_date"), k: int = SKETCH_K) -> DataFrame:
    """Per group a quantile sketch of its latencies, with their number and sum: a table of fixed-size rows that can be kept and merged.

    A sketch's quantile has a rank within ``SKETCH_ERROR`` of the one asked for, at ``SKETCH_K`` with a chance of 99 %, also after any
    number of merges.  Null latencies count nowhere.
    """
    known = joined.where(F.col("latency_ms").isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("total_ms"), F.kll_sketch_agg_double("latency_ms", k).alias("sketch")
    )


def latency_rollup(sketches: DataFrame, by: Sequence[str] = SYSTEM, k: int = SKETCH_K) -> DataFrame:
    """Mean, median and 95th percentile over many runs or days from their sketches alone; the exact form is :func:`latency_percentiles`."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total_ms").alias("_sum"), F.kll_merge_agg_double("sketch", k).alias("_all"))
    quantiles = F.kll_sketch_get_quantile_double("_all", F.array(F.lit(0.5), F.lit(0.95)))
    return merged.withColumn("_p", quantiles).select(
        *by,
        "n",
        round_dp(F.col("_sum") / F.col("n"), 2).alias("mean_ms"),
        F.col("_p")[0].alias("p50_ms"),
        F.col("_p")[1].alias("p95_ms"),
    )


def segment_breakdown(joined: DataFrame, by: Sequence[str] = SYSTEM) -> DataFrame:
    """Row count, intent accuracy, escalation recall and missed escalations per edge category."""
    keys = [*by, "edge_category"]
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        round_dp(ratio(count_if(F.col("true_intent") == F.col("pred_intent")), F.count(F.lit(1))), 4).alias("intent_accuracy"),
        *_escalation_counts("_"),
    ).select(
        *keys,
        "count",
        "intent_accuracy",
        round_dp(ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")), 4).alias("escalation_recall"),
        F.col("_fn").alias("missed_escalations_fn"),
    )


def composite_reliability(joined: DataFrame, by: Sequence[str] = SYSTEM, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of macro-F1, escalation F1 and grounding pass rate."""
    cells, core = _counted(joined, by)
    parts = core.select(
        *by,
        _escalation_scores()["f1"].alias("escalation_f1"),
        round_dp(ratio(F.col("_passes"), F.col("n")), 4).alias("grounding_pass_rate"),
    ).join(_accuracy_macro_f1(cells, by), list(by))
    return parts.select(*by, _reliability(weights).alias("composite_reliability"))


def _counted(joined: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The confusion table with every other count beside it, and its totals.

    It has one row per pair of labels and is written once, so that ``joined`` is read once.
    """
    sums = [
        *_escalation_counts(),
        *_autonomy_counts(),
        count_if(F.col("grounding_pass")).alias("_passes"),
        F.sum("grounding_score").alias("_score"),
    ]
    cells = materialise(_confusion(joined, by, sums), "confusion")
    counted = [c for c in cells.columns if c not in (*by, "true_intent", "pred_intent")]
    return cells, cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counted])


def _reliability(weights: dict[str, float] | None) -> Column:
    w = weights or D.RELIABILITY_WEIGHTS
    return round_dp(
        F.lit(w["macro_f1"]) * F.col("macro_f1")
        + F.lit(w["escalation_f1"]) * F.col("escalation_f1")
        + F.lit(w["grounding"]) * F.col("grounding_pass_rate"),
        4,
    )


def system_report(joined: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All metrics of every system, one row each.

    Every count and sum comes from one pass into a tiny confusion table; latencies take one
    more pass.  The joins meet one row per system.
    """
    keys = list(SYSTEM)
    cells, core = _counted(joined, keys)
    escalation = [c.alias(f"escalation_{n}") for n, c in _escalation_scores().items()]
    plain = core.select(
        *keys,
        F.col("n").alias("sample_count"),
        *escalation,
        "tp",
        "fp",
        "fn",
        "tn",
        *_autonomy_scores(),
        round_dp(ratio(F.col("_passes"), F.col("n")), 4).alias("grounding_pass_rate"),
        round_dp(ratio(F.col("_score"), F.col("n")), 4).alias("mean_grounding_score"),
    )
    return (
        plain.join(_accuracy_macro_f1(cells, keys), keys)
        .join(latency_percentiles(joined), keys)
        .withColumn("composite_reliability", _reliability(weights))
    )


COMPARED = (
    "macro_f1",
    "escalation_recall",
    "fn",
    "escalation_precision",
    "autonomy_resolvability_rate",
    "grounding_pass_rate",
    "composite_reliability",
    "p50_ms",
)


def system_comparison(
    report: DataFrame,
    systems: Sequence[str] = ("trivial_baseline", "simple_ml_baseline", "proposed_system"),
    metrics: Sequence[str] = COMPARED,
) -> DataFrame:
    """One row per metric with a column per system and the last system's gain over the one before it."""
    long = report.select("system_name", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        "system_name", list(metrics), "metric", "value"
    )
    wide = long.groupBy("metric").pivot("system_name", list(systems)).agg(F.first("value"))
    return wide.withColumn("delta", round_dp(F.col(systems[-1]) - F.col(systems[-2]), 4))
