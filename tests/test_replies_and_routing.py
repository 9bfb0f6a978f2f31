from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.functions.numeric import round_dp
from deskgraph.operators import grounding, replies, routing
from deskgraph.plans import message_scoring


def verdict(spark, reply, evidence, answer=None):
    rows = spark.createDataFrame([(reply, evidence, answer)], "generated_reply string, evidence_text string, answer string")
    return grounding.grounding_verdict(rows, verdict=grounding.parse_verdict(F.col("answer"))).first()


def test_unsupported_phone_number_fails(spark):
    got = verdict(spark, "Please call our line at 1-800-555-0199 right now.", "Send us a DM with your email.")
    assert got["grounding_pass"] is False and got["grounding_score"] < 0.5
    assert "phone" in got["unsupported_claims"][0] and "1-800-555-0199" in got["unsupported_claims"][0]


def test_unsupported_amount_fails_first(spark):
    got = verdict(spark, "We issued $150, call 800-555-0199", "Visit Help to submit a review.")
    assert (got["grounding_pass"], got["grounding_score"]) == (False, 0.2) and "$150" in got["unsupported_claims"][0]


def test_amounts_compare_without_case(spark):
    assert verdict(spark, "You get 5 DOLLARS", "we gave 5 dollars")["grounding_pass"] is True
    assert verdict(spark, "$5 and $ 7", "$5")["unsupported_claims"] == [D.CURRENCY_CLAIM % "$ 7"]


@pytest.mark.parametrize(
    "answer, passed, score",
    [
        (None, True, 0.85),
        ("{}", True, 1.0),
        ('{"grounding_pass": true, "grounding_score": 0.74}', False, 0.74),
        ('{"grounding_pass": false, "grounding_score": 0.9}', False, 0.9),
        ('{"grounding_pass": true, "grounding_score": 0.75}', True, 0.75),
    ],
)
def test_outside_verdict_decides_last(spark, answer, passed, score):
    got = verdict(spark, "Hi there, please send us a DM: https://t.co/help", "Please send us a DM", answer)
    assert (got["grounding_pass"], got["grounding_score"]) == (passed, score)


def route(spark, intent, conf, sim, ok, score, edge="standard", text=""):
    rows = spark.createDataFrame(
        [(intent, conf, sim, ok, score, edge, text)],
        "intent string, intent_confidence double, retrieval_similarity double, grounding_pass boolean, grounding_score double, edge_case_category string, raw_text string",
    )
    return routing.route_decision(rows).first()


def test_routing_cases(spark):
    cancel = "Cancellation_Fee_Dispute"
    got = route(spark, cancel, 0.95, 0.90, True, 0.95, text="the driver tried to Assault me")
    assert got["routing_decision"] == "ESCALATE" and "safety" in got["routing_reason"]
    assert route(spark, cancel, 0.95, 0.9, True, 0.95, edge=D.SAFETY_CATEGORY)["triggered_rules"] == [D.RULE_SAFETY]
    got = route(spark, "Driver_Behavior_Or_Safety", 0.85, 0.80, True, 0.90)
    assert got["triggered_rules"] == ["MANDATORY_INTENT_ESCALATION_DRIVER_BEHAVIOR_OR_SAFETY"]
    got = route(spark, cancel, 0.90, 0.85, True, 0.95)
    assert got["action"] == "auto_handle"
    assert got["routing_reason"] == "High intent confidence (0.90), strong historical evidence (0.85), and verified grounded reply (0.95)."
    got = route(spark, "Lost_Item_Inquiry", 0.20, 0.50, True, 0.80)
    assert got["composite_confidence"] == 0.515
    assert "below auto-handle threshold (0.7)" in got["routing_reason"]
    assert route(spark, cancel, 0.9, 0.85, False, 0.95)["triggered_rules"] == [D.RULE_GROUNDING]
    assert route(spark, cancel, 0.9, 0.85, True, 0.74)["routing_reason"].endswith("(score: 0.74 < 0.75).")
    assert route(spark, cancel, 0.9, 0.39, True, 0.95)["triggered_rules"] == [D.RULE_SIMILARITY]


@pytest.mark.parametrize("score", [1.0, 0.5])
def test_composite_of_equal_scores(spark, score):
    one = spark.range(1).select(routing.composite_confidence(F.lit(score), F.lit(score), F.lit(score)).alias("v"))
    assert one.first()["v"] == score


def test_reply_fallbacks_and_templates(value):
    assert value(replies.short_reply_fallback(F.col("r")), r="  ok  ") == D.SHORT_REPLY_TEMPLATE
    assert value(replies.short_reply_fallback(F.col("r")), r=None) == D.NO_REPLY_TEMPLATE
    assert value(replies.short_reply_fallback(F.col("r")), r=" " + "x" * 25) == "x" * 25
    made = replies.grounded_template_reply(F.col("r"), F.col("i"))
    assert value(made, r="@customer please send us a message", i="x") == "Hi there. please send us a message"
    assert value(made, r="@customer thanks", i="Lost_Item_Inquiry") == D.REPLY_POLICIES["Lost_Item_Inquiry"]
    assert value(made, r="http" + "s" * 30, i="??") == value(made, r=None, i=None) == D.REPLY_POLICIES[D.OTHER_INTENT]
    assert value(replies.canned_reply(F.col("i")), i="nope") == D.CANNED_DEFAULT


def test_reply_cache(spark):
    rows = spark.createDataFrame([(1, "hi", [5]), (2, "yo", [6]), (3, "hi", [7])], "id long, clean_text string, retrieved_case_ids array<long>")
    key = spark.range(1).select(replies.reply_key(F.lit("hi")).alias("k")).first()["k"]
    cache = spark.createDataFrame([(key, "stored", None)], "cache_key string, reply_text string, evidence_ids_used array<long>")
    got = {r["id"]: (r["reply_text"], r["evidence_ids_used"], r["cached"]) for r in replies.reply_cache_join(rows, cache, "id").collect()}
    assert got == {1: ("stored", [5], True), 2: (None, [6], False), 3: ("stored", [7], True)}
    assert [r["clean_text"] for r in replies.reply_cache_misses(rows, cache).collect()] == ["yo"]


def test_error_rows_escalate(spark):
    rows = spark.createDataFrame([(1, None, None)], "example_id long, input_text string, embedding array<float>")
    got = message_scoring.error_rows(rows.withColumn("error", message_scoring.invalid_reason())).first()
    assert (got["routing_decision"], got["predicted_intent"], got["error"]) == ("ESCALATE", D.OTHER_INTENT, "missing input_text")
    assert tuple(got.asDict()) == message_scoring.OUTPUT


def test_blank_message_escalates_as_other(spark):
    from deskgraph.operators import vectors

    base = spark.createDataFrame([(i, [float(i == 0), float(i == 1)], i) for i in range(2)], "id long, embedding array<float>, label int")
    corpus = base.select(F.col("id").alias("case_id"), F.lit("q").alias("customer_text"), F.lit("a long enough answer text").alias("brand_resolution"), "embedding")
    msgs = spark.createDataFrame([("m1", "    ", [1.0, 0.0]), ("m2", "where is it", [1.0, 0.0])], "example_id string, input_text string, embedding array<float>")
    msgs = msgs.withColumn("prior_turns", F.lit(None).cast("array<struct<role:string>>")).withColumn("edge_category", F.lit("standard"))
    model = vectors.Centroids.fit(vectors.prototype_centroids(base))
    got = {r["example_id"]: r for r in message_scoring.score_messages(msgs, model, corpus).collect()}
    assert (got["m1"]["routing_decision"], got["m1"]["predicted_intent"], got["m1"]["retrieved_case_ids"]) == ("ESCALATE", D.OTHER_INTENT, [])
    assert got["m2"]["retrieved_case_ids"] == [0, 1] and got["m2"]["generated_reply"].startswith("Hi there. a long")
    assert got["m2"]["execution_id"].startswith("exec_") and len(got["m2"]["execution_id"]) == 13


def test_prompts_fill_blank_columns(spark):
    rows = spark.createDataFrame([(" ctx\n", "  ", "100% sure")], "c string, e string, r string")
    got = replies.prompt_rows(rows, "C: %s\nE: %s\nR: %s (1%%)", ["c", "e", "r"], strip=True, when_blank={"e": "None provided."})
    assert got.first()["prompt"] == "C: ctx\nE: None provided.\nR: 100% sure (1%)"


def test_malformed_verdicts_count_as_unavailable(spark):
    answers = ["not json", "[1,2]", '{"grounding_score":"high"}', '{"grounding_score":null}', None, '{"grounding_pass":true}', '{"grounding_score":0.5}', "{}"]
    rows = spark.createDataFrame([(i, "fine", "", a) for i, a in enumerate(answers)], "i int, generated_reply string, evidence_text string, answer string")
    done = grounding.grounding_verdict(rows, verdict=grounding.parse_verdict(F.col("answer")))
    assert [r["grounding_score"] for r in done.orderBy("i").collect()] == [0.85] * 5 + [1.0, 0.5, 1.0]


def test_rounding_is_half_to_even(spark):
    values = [0.125, 0.375, 2.5, 6.25, -0.125]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(round_dp(F.col("v"), 2)).collect()] == [0.12, 0.38, 2.5, 6.25, -0.12]
    assert [r[0] for r in rows.select(round_dp(F.col("v"), 0)).collect()] == [0.0, 0.0, 2.0, 6.0, 0.0]
