"""The given tables seen as the engine's inputs.

Every view keeps all rows of its table.  Roles the tables lack (brands, parents, policies,
predictions) are derived from their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgraph.operators.skew import may_match
from deskgraph.session import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _string(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Reply graph: five brands, some parents not inbound, some parent ids without a message."""
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    tweet = conv * 1000 + turn
    brand = F.concat(F.lit("brand_"), _string(conv % 5))
    greeting = F.when(conv % 6 == 1, F.lit("Sorry, please DM us ")).otherwise(F.lit(""))
    body = (
        F.when(role == "user", F.concat(F.lit("@Brand_"), _string(conv % 5), F.lit(" "), "text"))
        .when(
            role == "assistant",
            F.concat(F.lit("@c"), _string(conv), F.lit(" "), greeting, "text", F.lit(" https://t.co/"), _string(turn)),
        )
        .otherwise(F.col("text"))
    )
    parent = F.when((turn == 3) & (conv % 7 == 0), conv * 1000 + 900).when(turn > 0, tweet - 1)
    return table(spark, sf, "conversations").select(
        tweet.alias("tweet_id"),
        F.when(role == "user", F.concat(F.lit("c"), _string(conv)))
        .when(role == "assistant", brand)
        .otherwise(F.lit("system"))
        .alias("author_id"),
        ((role == "user") & (conv % 11 != 3)).alias("inbound"),
        F.concat(F.lit("turn "), _string(turn)).alias("created_at"),
        body.alias("text"),
        F.when(role == "user", _string(tweet + 1)).alias("response_tweet_id"),
        parent.alias("in_response_to_tweet_id"),
    )


def is_brand() -> Column:
    return F.col("author_id").startswith("brand_")


def doc_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Working-set rows over the documents, whose texts hold exact copies."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("brand"),
        F.col("doc_id").alias("customer_tweet_id"),
        F.concat(F.lit("author_"), "lang").alias("customer_author"),
        F.col("text").alias("customer_text_clean"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") - 1).alias("customer_parent_id"),
        (F.col("doc_id") + 1000000000).alias("brand_tweet_id"),
        F.concat(F.lit("Reply from "), "source", F.lit(" to "), _string("n_chars"), F.lit(" characters")).alias("brand_reply_clean"),
        F.col("lang").alias("mapped_intent"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a past case, stored; its texts are two documents picked by its number.

    Texts of documents that no vector picks stay out of the joins.
    """
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count(F.lit(1))).scalar()
    picked = vectors(spark, sf).select(F.explode(F.array(F.col("vec_id") % n, (F.col("vec_id") + 1) % n)).alias("doc_id"))
    docs = may_match(docs, "doc_id", picked)
    asked = docs.select(F.col("doc_id").alias("_a"), F.col("text").alias("customer_text"))
    answered = docs.select(F.col("doc_id").alias("_b"), F.concat(F.lit("@customer "), "text").alias("brand_resolution"))
    joined = (
        vectors(spark, sf)
        .select(F.col("vec_id").alias("case_id"), "embedding", (F.col("vec_id") % n).alias("_a"), ((F.col("vec_id") + 1) % n).alias("_b"))
        .join(asked, "_a")
        .join(answered, "_b")
        .select("case_id", "customer_text", "brand_resolution", "embedding")
    )
    return materialise(joined, "cases")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chars = F.col("n_chars")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("example_id"),
        F.col("text").alias("customer_text"),
        F.col("lang").alias("gold_intent"),
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("ESCALATE"))
        .otherwise(F.lit("AUTO_HANDLE"))
        .alias("gold_routing_decision"),
        F.when(chars < 300, F.lit("low_info_vague"))
        .when(F.col("toxic") == 1, F.lit("safety_legal_escalate"))
        .otherwise(F.lit("standard"))
        .alias("edge_case_category"),
        F.when(chars < 400, F.lit("short")).when(chars < 1500, F.lit("medium")).otherwise(F.lit("long")).alias("length_bucket"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("follow_up")).otherwise(F.lit("first_turn")).alias("turn_position"),
        chars.alias("n_chars"),
    )


def predictions(gold_rows: DataFrame) -> DataFrame:
    """Three systems' answers for every gold row, actions in mixed case."""
    eid, chars, intent = F.col("example_id"), F.col("n_chars"), F.col("gold_intent")
    escalate = (F.col("gold_routing_decision") == "ESCALATE") | (chars % 3 == 0)

    def system(name, label, action, passed, score, latency):
        return F.struct(
            F.lit(name).alias("system_name"),
            label.alias("predicted_intent"),
            action.alias("routing_decision"),
            passed.alias("grounding_pass"),
            F.lit(score).alias("grounding_score"),
            latency.alias("latency_ms"),
        )

    answers = F.array(
        system("trivial_baseline", F.lit("en"), F.lit("auto_handle"), F.lit(True), 0.5, F.lit(0.0)),
        system(
            "simple_ml_baseline",
            F.when(eid % 4 == 0, F.lit("fr")).otherwise(intent),
            F.when(chars % 5 == 0, F.lit("escalate")).otherwise(F.lit("auto_handle")),
            eid % 9 != 0,
            1.0,
            (chars % 50).cast("double") / F.lit(10.0),
        ),
        system(
            "proposed_system",
            F.when(eid % 10 == 0, F.lit("other")).otherwise(intent),
            F.when(escalate, F.lit("ESCALATE")).otherwise(F.lit("AUTO_HANDLE")),
            eid % 20 != 0,
            0.95,
            (chars % 400).cast("double") / F.lit(4.0),
        ),
    )
    return gold_rows.select("example_id", F.inline(answers))


def judge_ratings(gold_rows: DataFrame) -> DataFrame:
    """Ratings with ties, one dimension without variance and one half point."""
    from deskgraph.functions.numeric import round_dp

    eid, chars = F.col("example_id"), F.col("n_chars")
    rated = gold_rows.select(
        "example_id",
        (1 + eid % 5).alias("grounding"),
        (1 + (eid + chars) % 5).alias("relevance"),
        F.lit(4).cast("bigint").alias("helpfulness"),
        (5 - eid % 2).alias("tone_fit"),
        (1 + chars % 5).alias("conciseness"),
    )
    total = F.col("grounding") + F.col("relevance") + F.col("helpfulness") + F.col("tone_fit") + F.col("conciseness")
    return rated.withColumn("overall_score", round_dp(total.cast("double") / F.lit(5.0), 2))


def human_ratings(gold_rows: DataFrame) -> DataFrame:
    eid, chars = F.col("example_id"), F.col("n_chars")
    return gold_rows.select(
        "example_id",
        (1 + (eid % 5 + chars % 2) % 5).alias("grounding"),
        (1 + (eid + chars % 3) % 5).alias("relevance"),
        (3 + eid % 3).alias("helpfulness"),
        (5 - eid % 3).alias("tone_fit"),
        (1 + (chars + eid % 2) % 5).alias("conciseness"),
        ((2 + eid % 4).cast("double") + F.lit(0.5)).alias("overall"),
    )


def route_inputs(gold_rows: DataFrame) -> DataFrame:
    """Inputs that reach every routing rule."""
    eid, chars = F.col("example_id"), F.col("n_chars")
    return gold_rows.select(
        "example_id",
        F.col("customer_text").alias("raw_text"),
        F.col("gold_intent").alias("intent"),
        ((chars % 101).cast("double") / F.lit(100.0)).alias("intent_confidence"),
        ((30 + eid % 70).cast("double") / F.lit(100.0)).alias("retrieval_similarity"),
        (eid % 12 != 0).alias("grounding_pass"),
        ((60 + chars % 41).cast("double") / F.lit(100.0)).alias("grounding_score"),
        "edge_case_category",
    )


MALFORMED = (None, "not json", "[1, 2]", '{"grounding_score": "high"}', '{"grounding_score": null}')


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Replies and evidence with amounts; the documents hold real phone numbers.

    Verdicts of an outside auditor come as JSON text and are missing or malformed for some rows.
    """
    docs = table(spark, sf, "documents")
    a = docs.select("doc_id", F.concat("text", F.lit(" We refund $"), _string(F.col("n_chars") % 7)).alias("reply_text"), "n_chars")
    b = docs.select(
        (F.col("doc_id") + 1).alias("doc_id"),
        F.concat("text", F.lit(" Past case $"), _string(F.col("doc_id") % 7), F.lit(" and 5 dollars")).alias("evidence_text"),
    )
    answer = F.when(
        F.col("n_chars") % 4 != 0,
        F.concat(
            F.lit('{"grounding_pass": '),
            F.when(F.col("n_chars") % 3 == 0, F.lit("false")).otherwise(F.lit("true")),
            F.lit(', "grounding_score": 0.'),
            _string(F.col("n_chars") % 40 + 60),
            F.lit("}"),
        ),
    ).otherwise(F.element_at(F.array(*[F.lit(v) for v in MALFORMED]), (F.col("doc_id") % len(MALFORMED) + 1).cast("int")))
    return a.join(b, "doc_id", "left").select(
        "doc_id", "reply_text", F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), answer.alias("answer")
    )
