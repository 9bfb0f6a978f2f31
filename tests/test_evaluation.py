from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deskgraph.operators import baselines, gold, judge, metrics

COLUMNS = "system_name string, true_intent string, pred_intent string, true_action string, pred_action string, grounding_pass boolean, grounding_score double, latency_ms double, edge_category string"


def joined(spark, intents=None, actions=None, passes=None, latencies=None):
    n = len(next(v for v in (intents, actions, passes, latencies) if v))
    intents, actions = intents or [("x", "x")] * n, actions or [("auto_handle", "auto_handle")] * n
    passes, latencies = passes or [(True, 1.0)] * n, latencies or [0.0] * n
    rows = [("s", *i, *a, *p, ms, "standard") for i, a, p, ms in zip(intents, actions, passes, latencies, strict=True)]
    return spark.createDataFrame(rows, COLUMNS)


def test_intent_metrics(spark):
    rows = joined(spark, intents=[("B", "B"), ("D", "D"), ("B", "L"), ("L", "L")])
    got = metrics.intent_accuracy_macro_f1(rows).first()
    assert got["accuracy"] == 0.75
    assert got["macro_f1"] == pytest.approx((2 / 3 + 1 + 2 / 3) / 3, abs=1e-4)
    assert metrics.per_class_prf(rows).where("label = 'B'").first()["recall"] == 0.5


def test_macro_f1_counts_labels_that_are_only_predicted(spark):
    got = metrics.intent_accuracy_macro_f1(joined(spark, intents=[("A", "A"), ("A", "Z")])).first()
    assert got["macro_f1"] == pytest.approx((2 / 3 + 0) / 2, abs=1e-4)


def test_escalation_and_autonomy(spark):
    e, a = "escalate", "auto_handle"
    got = metrics.escalation_confusion(joined(spark, actions=[(e, e), (e, e), (a, e), (a, a)])).first()
    assert (got["recall"], got["fn"], got["tp"] + got["fp"] + got["fn"] + got["tn"]) == (1.0, 0, 4) and got["precision"] < 1
    got = metrics.autonomy_resolvability(joined(spark, actions=[(a, a), (a, a), (e, a), (e, e)])).first()
    assert tuple(got)[1:] == (3, 2, 1, 0.6667)
    got = metrics.autonomy_resolvability(joined(spark, actions=[(a, e)])).first()
    assert tuple(got)[1:] == (0, None, None, 0.0)


def test_grounding_and_latency(spark):
    got = metrics.grounding_rate(joined(spark, passes=[(True, 0.9), (True, 0.85), (True, 0.95), (False, 0.3)])).first()
    assert (got["grounding_pass_rate"], got["mean_grounding_score"]) == (0.75, 0.75)
    none = metrics.grounding_rate(joined(spark, passes=[(True, 1.0)]).where("false"), by=()).first()
    assert tuple(none) == (0.0, 0.0)
    got = metrics.latency_percentiles(joined(spark, latencies=[1.0, 2.0, 3.0, 10.0, 10.0])).first()
    assert (got["mean_ms"], got["p50_ms"], got["p95_ms"]) == (5.2, 3.0, 10.0)
    got = metrics.latency_percentiles(joined(spark, latencies=[0.0, 10.0])).first()
    assert (got["p50_ms"], got["p95_ms"]) == (5.0, 9.5)


def test_join_defaults_and_mixed_case(spark):
    preds = spark.createDataFrame([("s", 1, "A", "ESCALATE"), ("s", 9, "A", "x")], "system_name string, example_id long, predicted_intent string, routing_decision string")
    truth = spark.createDataFrame([("1", "A", None, "Escalate")], "example_id string, gold_intent string, gold_routing_decision string, gold_action string")
    got = metrics.prediction_gold_join(preds, truth).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["true_action"], r["pred_action"], r["grounding_pass"], r["grounding_score"], r["latency_ms"], r["edge_category"]) == ("escalate", "escalate", True, 1.0, 0.0, "standard")


def test_kappa_against_the_formula_and_undefined(spark):
    rows = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "x string, y string")
    assert gold.cohens_kappa(rows, "x", "y").first()["kappa"] == 0.4
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    assert gold.cohens_kappa(same, "x", "y").first()["kappa"] is None
    assert gold.cohens_kappa(same, "x", "y", undefined=0.6).first()["kappa"] == 0.6


def pairs(spark, judge_values, human_values, dim="d"):
    return spark.createDataFrame([(dim, float(j), float(h)) for j, h in zip(judge_values, human_values, strict=True)], "dim string, judge double, human double")


def test_spearman_with_ties_and_p_value(spark):
    j, h = [1, 2, 3, 4, 5, 5, 1], [2, 1, 4, 3, 5, 4, 2]
    rho = np.corrcoef(pd.Series(j).rank(), pd.Series(h).rank())[0, 1]
    rows = pairs(spark, j, h)
    got = judge.spearman_agreement(rows).first()
    assert (got["n"], got["spearman"]) == (7, round(rho, 4))
    # Tail of Student's t with 5 degrees of freedom by plain integration.
    t = rho * (5 / (1 - rho * rho)) ** 0.5
    x = np.linspace(t, 2000, 20_000_001)
    y = math.gamma(3) / (math.sqrt(5 * math.pi) * math.gamma(2.5)) * (1 + x * x / 5) ** -3
    expected = 2 * float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))
    assert judge.spearman_p_value(rows).first()["p_value"] == pytest.approx(expected, abs=2e-5)


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.073388), (0.0, 5, 1.0), (12.706, 1, 0.05), (1.96, 100000, 0.05)])
def test_t_tail_matches_tables(t, df, p):
    assert judge._t_tail(t, df) == pytest.approx(p, abs=2e-5)


def test_undefined_correlation_and_few_pairs(spark):
    assert judge.spearman_agreement(pairs(spark, [4] * 6, [1, 2, 3, 4, 5, 5])).first()["spearman"] == 0.5
    assert judge.spearman_p_value(pairs(spark, [4] * 6, [1, 2, 3, 4, 5, 5])).first()["p_value"] == 0.01
    assert judge.spearman_agreement(pairs(spark, [1, 2, 3, 4], [1, 2, 3, 4])).count() == 0
    none = judge.agreement_summary(judge.agreement_report(pairs(spark, [1], [1]))).first()
    assert tuple(none) == (0.55, 0.62, 0.42)


def test_half_points_round_to_even(spark):
    got = judge.exact_match_rate(pairs(spark, [2.5, 3.5, 4.0], [2.0, 4.0, 4.5])).first()
    assert got["exact_match_rate"] == 1.0


def test_judge_rules(spark):
    rows = spark.createDataFrame([("word " * 12,), ("dm " + "w " * 60,), ("help",), ("",), (None,)], "reply string")
    got = [(r["relevance"], r["conciseness"], r["overall_score"]) for r in judge.judge_heuristic(rows).collect()]
    assert got == [(2, 5, 3.8), (4, 2, 3.6), (4, 3, 3.8), (2, 3, 3.4), (2, 3, 3.4)]
    raw = spark.createDataFrame([(0, 9, None, 3, 5)], ", ".join(f"{d} int" for d in judge.DIMENSIONS))
    assert tuple(judge.judge_clamp(raw).first()) == (1, 5, 3, 3, 5, 3.4)


def test_trained_baseline_learns_and_saves(spark, tmp_path):
    from deskgraph.sources import readers, writers

    data = [(i, f"refund my fare number {i}" if i % 2 else f"lost phone in the car {i}", f"reply {i}", "Fare" if i % 2 else "Lost") for i in range(40)]
    train = spark.createDataFrame(data, "case_id long, customer_text string, brand_resolution string, pseudo_intent string")
    model = baselines.logistic_intent(train, features=50)
    writers.save_model(model, str(tmp_path / "m"))
    rows = spark.createDataFrame([("a", "REFUND the fare"), ("b", "my phone is lost, call Police police")], "example_id string, customer_text string")
    got = {r["example_id"]: r for r in baselines.simple_ml_baseline(readers.load_model(str(tmp_path / "m")), rows, train).collect()}
    assert (got["a"]["predicted_intent"], got["b"]["predicted_intent"]) == ("Fare", "Lost")
    assert got["a"]["input_text"] == "REFUND the fare" and got["a"]["generated_reply"] == "reply 1"
    assert got["b"]["routing_decision"] == "escalate" and got["b"]["routing_reason"].endswith(": police")
    assert tuple(got["a"].asDict()) == baselines.OUTPUT
    trivial = baselines.trivial_baseline(rows).first()
    assert tuple(trivial.asDict()) == baselines.OUTPUT and trivial["routing_decision"] == "auto_handle"


def test_gold_set_keeps_quotas_and_size(spark):
    pool = spark.range(400).select(
        F.col("id").alias("customer_tweet_id"),
        F.when(F.col("id") % 3 == 0, F.lit("safety_legal_escalate")).otherwise(F.lit("standard")).alias("edge_category"),
        F.when(F.col("id") % 2 == 0, F.lit("Lost_Item_Inquiry")).otherwise(F.lit("Fare_Dispute_Or_Refund")).alias("mapped_intent"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("customer_text_clean"),
        F.lit(True).alias("is_first_turn"),
        F.lit("short").alias("length_bucket"),
        F.lit("reply").alias("brand_reply_clean"),
    )
    got = gold.build_golden_set(pool, target=60)
    assert got.count() == 60 and got.select("customer_tweet_id").distinct().count() == 60
    ids = sorted(r["example_id"] for r in got.collect())
    assert (ids[0], ids[-1]) == ("gold_001", "gold_060")
    assert got.where("edge_case_category = 'safety_legal_escalate' and gold_routing_decision <> 'ESCALATE'").count() == 0
    assert got.where("edge_case_category = 'safety_legal_escalate'").count() >= 16
    assert min(r["count"] for r in got.groupBy("gold_intent").count().collect()) >= 20
    assert gold.build_golden_set(pool, target=10).count() == 10


@pytest.mark.parametrize(("target", "per_intent", "quotas"), [(30, 5, {"a": 4, "b": 7, "gone": 3}), (12, 6, {"a": 9, "b": 9}), (200, 3, {"a": 1}), (5, 0, {})])
def test_one_ranking_pass_selects_what_the_steps_select(spark, target, per_intent, quotas):
    pool = spark.range(150).select(
        F.col("id").alias("customer_tweet_id"),
        F.when(F.col("id") % 4 == 0, F.lit("a")).when(F.col("id") % 7 == 0, F.lit("b")).when(F.col("id") % 5 > 0, F.lit("standard")).alias("edge_category"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("i"), (F.col("id") % 6).cast("string"))).alias("mapped_intent"),
        F.lit("wide").alias("text"),
    )
    narrow = pool.drop("text")
    edges = gold.stratified_sample_edges(narrow, quotas) if quotas else narrow.where("false")
    chosen = edges.unionByName(gold.stratified_fill_quota(narrow, edges, per_intent).select(*narrow.columns))
    want = {r["customer_tweet_id"] for r in gold.sample_fill_remainder(narrow, chosen, target).collect()}
    got = gold.select_gold(pool, target, edge_quotas=quotas, per_intent=per_intent)
    assert {r["customer_tweet_id"] for r in got.collect()} == want and set(got.columns) == set(pool.columns)


def test_latency_sketches_of_days_merge_within_their_error(spark):
    rng = np.random.default_rng(4)
    ms = np.concatenate([rng.gamma(2.0, 40.0, 6000), rng.uniform(900, 1000, 300)])
    rows = spark.createDataFrame([("a", f"d{i % 9}", float(v)) for i, v in enumerate(ms)] + [("a", "d0", None), ("b", "d1", 5.0)], "system_name string, run_date string, latency_ms double")
    daily = metrics.latency_sketches(rows)
    assert daily.count() == 10
    got = {r["system_name"]: r for r in metrics.latency_rollup(daily).collect()}
    assert got["a"]["n"] == len(ms) and got["a"]["mean_ms"] == pytest.approx(ms.mean(), abs=0.006)
    for name, share in (("p50_ms", 0.5), ("p95_ms", 0.95)):
        assert abs((ms <= got["a"][name]).mean() - share) <= metrics.SKETCH_ERROR + 1 / len(ms)
        assert got["b"][name] == 5.0
    assert metrics.latency_rollup(daily.where("false")).count() == 0
