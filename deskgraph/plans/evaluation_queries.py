"""Baselines, metrics and judge agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.operators import baselines, judge, metrics
from deskgraph.plans import tables as t
from deskgraph.plans.oracle import q, sql, strip, word_count
from deskgraph.plans.registry import query
from deskgraph.session import shared_folder


def joined(spark, sf):
    rows = t.gold(spark, sf)
    return metrics.prediction_gold_join(t.predictions(rows), rows)


@query(
    "trivial_baseline",
    sql(
        f"""SELECT 'trivial_baseline' AS system_name, example_id, customer_text AS input_text, 'Fare_Dispute_Or_Refund' AS predicted_intent,
        0.5::DOUBLE AS intent_confidence, {q(D.CANNED_REPLIES['Fare_Dispute_Or_Refund'])} AS generated_reply, 'auto_handle' AS routing_decision,
        {q(D.TRIVIAL_REASON)} AS routing_reason, 0.5::DOUBLE AS grounding_score, true AS grounding_pass, 0.0::DOUBLE AS latency_ms FROM gold"""
    ),
)
def _(spark, sf):
    return baselines.trivial_baseline(t.gold(spark, sf))


@query("prediction_gold_join", sql("SELECT * FROM joined"))
def _(spark, sf):
    return joined(spark, sf)


@query("intent_accuracy_macro_f1", sql("SELECT * FROM macro"))
def _(spark, sf):
    return metrics.intent_accuracy_macro_f1(joined(spark, sf))


@query(
    "per_class_prf",
    sql(
        "SELECT system_name, label, round_even(prec, 4) AS precision, round_even(rec, 4) AS recall, round_even(f1, 4) AS f1, CAST(t AS BIGINT) AS support FROM f1s"
    ),
)
def _(spark, sf):
    return metrics.per_class_prf(joined(spark, sf))


@query(
    "escalation_confusion",
    sql(
        """SELECT system_name, round_even(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 4) AS accuracy, round_even(prec, 4) AS precision, round_even(rec, 4) AS recall,
        round_even(f1, 4) AS f1, tp, fp, fn, tn FROM esc"""
    ),
)
def _(spark, sf):
    return metrics.escalation_confusion(joined(spark, sf))


@query("autonomy_resolvability", sql("SELECT * FROM autonomy"))
def _(spark, sf):
    return metrics.autonomy_resolvability(joined(spark, sf))


@query("grounding_rate", sql("SELECT * FROM grounded"))
def _(spark, sf):
    return metrics.grounding_rate(joined(spark, sf))


@query("latency_percentiles", sql("SELECT * FROM latency"))
def _(spark, sf):
    return metrics.latency_percentiles(joined(spark, sf))


@query(
    "latency_rollup",
    sql("SELECT system_name, count(*) AS n, round_even(avg(latency_ms), 2) AS mean_ms, true AS p50_within_error, true AS p95_within_error FROM joined GROUP BY system_name"),
)
def _(spark, sf):
    """Two appends of sketches, one a run that is repeated, rolled up; the quantiles' ranks are worked out from all latencies."""
    rows, path = joined(spark, sf), shared_folder(spark, "latency-sketches")
    for day, part in (("2024-01-01", rows.where("pmod(xxhash64(example_id), 3) = 0")), ("2024-01-02", rows.where("pmod(xxhash64(example_id), 3) > 0"))):
        for _attempt in range(2):
            kept = metrics.latency_sketches(part, metrics.SYSTEM).withColumn("run_date", F.lit(day))
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
    rolled = metrics.latency_rollup(spark.read.parquet(path))
    value = F.col("latency_ms")
    checks = []
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        below, upto = F.avg((value < F.col(f"{name}_ms")).cast("double")), F.avg((value <= F.col(f"{name}_ms")).cast("double"))
        checks.append(((below <= share + metrics.SKETCH_ERROR) & (upto >= share - metrics.SKETCH_ERROR)).alias(f"{name}_within_error"))
    return rows.join(rolled, "system_name").groupBy("system_name", "n", "mean_ms").agg(*checks)


@query(
    "segment_breakdown",
    sql(
        """SELECT system_name, edge_category, count(*) AS count, round_even(CAST(count(*) FILTER (true_intent = pred_intent) AS DOUBLE) / count(*), 4) AS intent_accuracy,
        CASE WHEN count(*) FILTER (true_action = 'escalate') = 0 THEN 0.0::DOUBLE
             ELSE round_even(CAST(count(*) FILTER (true_action = 'escalate' AND pred_action = 'escalate') AS DOUBLE) / count(*) FILTER (true_action = 'escalate'), 4) END AS escalation_recall,
        count(*) FILTER (true_action = 'escalate' AND pred_action <> 'escalate') AS missed_escalations_fn
        FROM joined GROUP BY system_name, edge_category"""
    ),
)
def _(spark, sf):
    return metrics.segment_breakdown(joined(spark, sf))


@query("composite_reliability", sql("SELECT system_name, composite_reliability FROM report"))
def _(spark, sf):
    return metrics.composite_reliability(joined(spark, sf))


@query("system_report", sql("SELECT * FROM report"))
def _(spark, sf):
    return metrics.system_report(joined(spark, sf))


@query(
    "system_comparison",
    sql(
        "SELECT metric, trivial_baseline, simple_ml_baseline, proposed_system, round_even(proposed_system - simple_ml_baseline, 4) + 0.0::DOUBLE AS delta FROM ("
        + " UNION ALL ".join(
            f"SELECT {q(m)} AS metric, "
            + ", ".join(
                f"(SELECT CAST({m} AS DOUBLE) FROM report WHERE system_name = {q(s)}) AS {s}"
                for s in ("trivial_baseline", "simple_ml_baseline", "proposed_system")
            )
            for m in metrics.COMPARED
        )
        + ")"
    ),
)
def _(spark, sf):
    return metrics.system_comparison(metrics.system_report(joined(spark, sf)))


# ----------------------------------------------------------------------- judge

def _replies(spark, sf):
    """Every assistant turn as a reply to rate, in the context of its conversation and turn."""
    return t.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"),
        F.concat(F.lit(" conversation "), F.col("conv_id").cast("string"), F.lit("\n")).alias("context"),
        F.lit("").alias("evidence"),
        F.col("text").alias("reply"),
        F.when(F.col("turn") % 3 == 0, F.lit("ESCALATE")).otherwise(F.lit("AUTO_HANDLE")).alias("routing_decision"),
        F.when(F.col("role") == "user", F.lit("standard")).otherwise(F.lit("low_info_vague")).alias("edge_case_category"),
        F.concat(F.lit("system_"), F.col("role")).alias("system_name"),
    )


_REPLIES = """SELECT conv_id * 1000 + turn AS example_id, concat(' conversation ', CAST(conv_id AS VARCHAR), chr(10)) AS context, '' AS evidence, text AS reply,
    CASE WHEN turn % 3 = 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS routing_decision,
    CASE WHEN role = 'user' THEN 'standard' ELSE 'low_info_vague' END AS edge_case_category, concat('system_', role) AS system_name FROM conversations"""
_WORDS = ["the", "les", "und", "que"]
_SCORES = "grounding, relevance, helpfulness, tone_fit, conciseness"
_MEAN = "round_even(CAST(grounding + relevance + helpfulness + tone_fit + conciseness AS DOUBLE) / 5.0::DOUBLE, 2) AS overall_score"
_HEURISTIC = f"""SELECT *, {_MEAN} FROM (SELECT *, CAST(4 AS BIGINT) AS grounding,
    CAST(CASE WHEN {' OR '.join(f"contains(lower(reply), '{w}')" for w in _WORDS)} THEN 4 ELSE 2 END AS BIGINT) AS relevance,
    CAST(4 AS BIGINT) AS helpfulness, CAST(4 AS BIGINT) AS tone_fit,
    CAST(CASE WHEN n BETWEEN 10 AND 35 THEN 5 WHEN n <= 55 THEN 3 ELSE 2 END AS BIGINT) AS conciseness
    FROM (SELECT *, {word_count('reply')} AS n FROM rated_replies))"""
_RULED = f"""SELECT *, {_MEAN} FROM (SELECT *, CAST(CASE WHEN edge_case_category = 'standard' THEN 5 ELSE 4 END AS BIGINT) AS grounding,
    CAST(CASE WHEN length(context) > 10 THEN 5 ELSE 4 END AS BIGINT) AS relevance,
    CAST(CASE WHEN routing_decision = 'ESCALATE' THEN 4 ELSE 5 END AS BIGINT) AS helpfulness, CAST(5 AS BIGINT) AS tone_fit,
    CAST(CASE WHEN {word_count('reply')} <= 40 THEN 5 ELSE 4 END AS BIGINT) AS conciseness FROM rated_replies)"""
_JUDGE_VIEWS = {"rated_replies": _REPLIES, "heuristic": _HEURISTIC, "ruled": _RULED}


def _judge_sql(body: str) -> str:
    return sql(body, **_JUDGE_VIEWS)


@query("judge_heuristic", _judge_sql(f"SELECT example_id, {_SCORES}, overall_score FROM heuristic"))
def _(spark, sf):
    return judge.judge_heuristic(_replies(spark, sf), relevance_words=_WORDS).select(
        "example_id", *judge.DIMENSIONS, "overall_score"
    )


@query("judge_rule_scores", _judge_sql(f"SELECT example_id, {_SCORES}, overall_score FROM ruled"))
def _(spark, sf):
    return judge.judge_rule_scores(_replies(spark, sf)).select("example_id", *judge.DIMENSIONS, "overall_score")


_RAW = "CASE WHEN doc_id % 9 = 4 THEN NULL WHEN n_chars % 7 = {k} THEN NULL ELSE n_chars % {m} - 1 END"  # one text rating spoils the set


@query(
    "judge_clamp",
    f"SELECT doc_id, {_SCORES}, {_MEAN} FROM (SELECT doc_id, "
    + ", ".join(
        f"CAST(greatest(1, least(5, coalesce({_RAW.format(k=i, m=6 + i)}, 3))) AS BIGINT) AS {d}"
        for i, d in enumerate(judge.DIMENSIONS)
    )
    + " FROM documents)",
)
def _(spark, sf):
    chars = F.col("n_chars")
    raw = [
        F.when((F.col("doc_id") % 9 == 4) & (i < 2), F.lit("good"))
        .when(chars % 7 != i, (chars % (6 + i) - 1).cast("string"))
        .alias(d)
        for i, d in enumerate(judge.DIMENSIONS)
    ]
    return judge.judge_clamp(t.table(spark, sf, "documents").select("doc_id", *raw))


@query(
    "judge_cache_join",
    _judge_sql(
        f"""SELECT h.example_id, h.cache_key, {', '.join(f'CASE WHEN c.cache_key IS NULL THEN h.{d} ELSE c.{d} END AS {d}' for d in (*judge.DIMENSIONS, 'overall_score'))},
        c.cache_key IS NOT NULL AS cached
        FROM (SELECT *, sha256(concat({strip('context')}, '|', {strip('evidence')}, '|', {strip('reply')})) AS cache_key FROM heuristic) h
        LEFT JOIN (SELECT sha256(concat({strip('context')}, '|', {strip('evidence')}, '|', {strip('reply')})) AS cache_key,
            {', '.join(f'max({d}) AS {d}' for d in (*judge.DIMENSIONS, 'overall_score'))} FROM ruled WHERE edge_case_category = 'standard' GROUP BY 1) c
        ON c.cache_key = h.cache_key"""
    ).replace("contains(lower(reply), 'the') OR contains(lower(reply), 'les') OR contains(lower(reply), 'und') OR contains(lower(reply), 'que')",
              " OR ".join(f"contains(lower(reply), '{w}')" for w in D.JUDGE_RELEVANCE_WORDS)),
)
def _(spark, sf):
    rows = _replies(spark, sf)
    key = judge.judge_key(F.col("context"), F.col("evidence"), F.col("reply"))
    ruled = judge.judge_rule_scores(rows.where(F.col("edge_case_category") == "standard")).withColumn("cache_key", key)
    names = (*judge.DIMENSIONS, "overall_score")
    cache = ruled.groupBy("cache_key").agg(*[F.max(c).alias(c) for c in names])
    return judge.judge_cache_join(rows, cache, "example_id").select("example_id", "cache_key", *names, "cached")


@query(
    "judge_mean",
    _judge_sql(
        """SELECT system_name, count(*) AS rated, round_even(avg(overall_score), 2) AS mean_score FROM ruled GROUP BY system_name"""
    ),
)
def _(spark, sf):
    return judge.judge_mean(judge.judge_rule_scores(_replies(spark, sf)))


@query(
    "reference_ratings",
    sql(
        f"""SELECT example_id, {_SCORES}, round_even(CAST(grounding + relevance + helpfulness + tone_fit + conciseness AS DOUBLE) / 5.0::DOUBLE, 2) AS overall
        FROM (SELECT example_id, CAST(CASE edge_case_category WHEN 'standard' THEN 5 WHEN 'low_info_vague' THEN 4 ELSE 3 END AS BIGINT) AS grounding,
        CAST(CASE WHEN edge_case_category = 'low_info_vague' THEN 3 ELSE 5 END AS BIGINT) AS relevance,
        CAST(CASE WHEN gold_routing_decision = 'ESCALATE' THEN 4 ELSE 5 END AS BIGINT) AS helpfulness, CAST(5 AS BIGINT) AS tone_fit,
        CAST(CASE WHEN length_bucket IN ('short', 'medium') THEN 5 ELSE 4 END AS BIGINT) AS conciseness FROM gold)"""
    ),
)
def _(spark, sf):
    return judge.reference_ratings(t.gold(spark, sf))


def ratings(spark, sf):
    rows = t.gold(spark, sf)
    return judge.paired_ratings(t.judge_ratings(rows), t.human_ratings(rows))


@query(
    "spearman_agreement",
    sql("SELECT dim, n, coalesce(raw, 0.5::DOUBLE) + 0.0::DOUBLE AS spearman FROM rho WHERE n >= 5"),
)
def _(spark, sf):
    return judge.spearman_agreement(ratings(spark, sf))


# With t = r * sqrt(v / (1 - r^2)) for v degrees of freedom the two-sided tail of Student's t is a constant times the integral of
# cos(a)^(v - 1) from asin(|r|) to a right angle, here by Simpson's rule.
_TAIL_SQL = sql(
    f"""SELECT dim, n, round_even(r, 12) AS spearman, CASE WHEN r IS NULL THEN {D.UNDEFINED_P_VALUE}::DOUBLE WHEN abs(r) >= 1 THEN 0.0::DOUBLE
        ELSE round_even(2 * exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE)) / sqrt(pi()) * width / 3 * total, 5) END AS p_value
    FROM (SELECT dim, n, r, (pi() / 2 - asin(least(1.0::DOUBLE, abs(coalesce(r, 0))))) / 4000 AS width,
            list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i % 4000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                * pow(greatest(0.0::DOUBLE, cos(asin(least(1.0::DOUBLE, abs(coalesce(r, 0)))) + i * (pi() / 2 - asin(least(1.0::DOUBLE, abs(coalesce(r, 0))))) / 4000)), n - 3))) AS total
        FROM (SELECT dim, count(*) AS n, CASE WHEN stddev_pop(rj) > 0 AND stddev_pop(rh) > 0 THEN corr(rj, rh) END AS r FROM ranked GROUP BY dim HAVING count(*) >= 5))"""
)


@query("spearman_p_value", _TAIL_SQL)
def _(spark, sf):
    return judge.spearman_p_value(ratings(spark, sf))


@query("mean_abs_error", sql("SELECT dim, round_even(avg(abs(judge - human)), 4) AS mean_absolute_error FROM ratings GROUP BY dim"))
def _(spark, sf):
    return judge.mean_abs_error(ratings(spark, sf))


_EXACT = "SELECT dim, round_even(CAST(count(*) FILTER (round_even(judge, 0) = round_even(human, 0)) AS DOUBLE) / count(*), 4) AS exact_match_rate FROM ratings GROUP BY dim"


@query("exact_match_rate", sql(_EXACT))
def _(spark, sf):
    return judge.exact_match_rate(ratings(spark, sf))


@query("pass_fail_kappa", sql("SELECT dim, kappa + 0.0::DOUBLE AS cohen_kappa_pass_fail FROM kappas"))
def _(spark, sf):
    return judge.pass_fail_kappa(ratings(spark, sf))


_AGREEMENT = f"""SELECT r.dim, r.n, coalesce(r.raw, 0.5::DOUBLE) + 0.0::DOUBLE AS spearman, k.kappa + 0.0::DOUBLE AS cohen_kappa_pass_fail,
    m.mean_absolute_error, e.exact_match_rate FROM rho r JOIN kappas k USING (dim)
    JOIN (SELECT dim, round_even(avg(abs(judge - human)), 4) AS mean_absolute_error FROM ratings GROUP BY dim) m USING (dim)
    JOIN ({_EXACT}) e USING (dim) WHERE r.n >= 5"""


@query("agreement_report", sql(_AGREEMENT))
def _(spark, sf):
    return judge.agreement_report(ratings(spark, sf))


@query(
    "agreement_summary",
    sql(
        f"""SELECT spearman AS overall_spearman_correlation, cohen_kappa_pass_fail AS overall_cohen_kappa, mean_absolute_error AS overall_mae
        FROM ({_AGREEMENT}) WHERE dim = 'overall'"""
    ),
)
def _(spark, sf):
    return judge.agreement_summary(judge.agreement_report(ratings(spark, sf)))
