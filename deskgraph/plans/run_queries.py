"""The evaluation run: three systems answer one gold set, and their own outputs are compared.

The gold set comes from the evaluation pool; encoder, centroids, case indexes and the trained baseline see the retrieval pool only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.operators import baselines, gold, intent, metrics, sampling, tfidf
from deskgraph.operators.case_index import CaseIndex
from deskgraph.operators.encoder import TextEncoder
from deskgraph.operators.text_index import TextIndex
from deskgraph.operators.threads import TURN_TYPE
from deskgraph.plans import message_scoring
from deskgraph.plans.gold_queries import INTENTS, QUOTAS, pool
from deskgraph.plans.registry import query
from deskgraph.plans.scoring_queries import SETTINGS
from deskgraph.plans.vector_queries import STOPS
from deskgraph.session import materialise

COMMON = ("system_name", "example_id", "predicted_intent", "routing_decision", "grounding_pass", "grounding_score", "latency_ms")


def pools(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Training cases of the retrieval pool, without texts that stand in the other, and the gold set of the evaluation pool."""
    rows = sampling.holdout_split(pool(spark, sf), "customer_tweet_id")
    held = sampling.split_filter(rows, D.EVAL_POOL).drop("split")
    examples = materialise(gold.gold_annotation(gold.gold_example_id(gold.select_gold(held, edge_quotas=QUOTAS)), **INTENTS), "gold-run")
    train = sampling.split_filter(rows, D.RETRIEVAL_POOL).select(
        F.col("brand_tweet_id").alias("case_id"),
        "customer_tweet_id",
        F.col("customer_text_clean").alias("customer_text"),
        F.col("brand_reply_clean").alias("brand_resolution"),
        F.col("mapped_intent").alias("label"),
    )
    seen = held.select(F.col("customer_text_clean").alias("customer_text")).distinct()
    return materialise(train.join(seen, "customer_text", "left_anti"), "run-training"), examples


def predictions(train: DataFrame, examples: DataFrame) -> DataFrame:
    """The three systems' outputs for every example."""
    # terms are counted once for the encoder and the text index, and texts encoded once for the centroids and the cases
    counts = tfidf.top_terms(train, "customer_text", STOPS, 1, D.TFIDF_FEATURES, "run-terms")
    encoder = TextEncoder.fit(train, "customer_text", stops=STOPS, counts=counts)
    encoded = materialise(encoder.apply(train.drop("customer_tweet_id"), "customer_text"), "run-cases")
    model = encoder.centroids(encoded, "label", "customer_text", vector="embedding")
    cases = encoded.drop("label")
    labelled = intent.centroid_batch_label(cases, model, threshold=SETTINGS.intent_threshold).withColumnRenamed("mapped_intent", "pseudo_intent")
    learned = baselines.logistic_intent(materialise(labelled.select("case_id", "customer_text", "brand_resolution", "pseudo_intent"), "run-labelled"))
    asked = examples.select("example_id", "customer_text")
    majority = labelled.groupBy("pseudo_intent").count().orderBy(F.desc("count"), "pseudo_intent").first()["pseudo_intent"]
    trivial = baselines.trivial_baseline(asked, majority_intent=majority)
    texts = TextIndex.build(cases, stops=STOPS, counts=counts)
    simple = baselines.simple_ml_baseline(learned, asked, cases.drop("embedding"), index=texts)
    messages = encoder.apply(examples, "customer_text").select(
        "example_id",
        F.col("customer_text").alias("input_text"),
        F.array().cast(TURN_TYPE).alias("prior_turns"),
        F.col("edge_case_category").alias("edge_category"),
        "embedding",
    )
    index = CaseIndex.build(cases, width=encoder.dimensions, with_cases=True)
    proposed = message_scoring.score_messages(messages, model, index, SETTINGS).withColumn("system_name", F.lit("proposed_system"))
    return materialise(reduce(DataFrame.unionByName, [p.select(*COMMON) for p in (trivial, simple, proposed)]), "run-predictions")


@query("evaluation_run")
def _(spark, sf):
    train, examples = pools(spark, sf)
    return metrics.system_report(metrics.prediction_gold_join(predictions(train, examples), examples))


@query("evaluation_run_leakage", "SELECT least(200, count(*) - floor(count(*) * 0.8))::BIGINT AS examples, 0::BIGINT AS shared_ids, 0::BIGINT AS shared_texts FROM documents")
def _(spark, sf):
    """Examples whose id or text the training cases hold."""
    train, examples = pools(spark, sf)
    shared = lambda key: examples.join(train.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1))).scalar()
    return examples.agg(F.count(F.lit(1)).alias("examples")).select(
        "examples", shared("customer_tweet_id").alias("shared_ids"), shared("customer_text").alias("shared_texts")
    )
