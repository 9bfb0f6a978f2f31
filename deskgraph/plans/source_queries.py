"""Sources, sinks, saved models and streams.

Each query writes what Spark derives from the given tables to the shared folder, reads it back,
and returns what was read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.operators import baselines, brands, profile, routing
from deskgraph.plans import tables as t
from deskgraph.plans.corpus_queries import WORKING_SQL, _scored_sql, working_set
from deskgraph.plans.gold_queries import _sql as gold_sql
from deskgraph.plans.gold_queries import golden
from deskgraph.plans.oracle import has_word, has_words_in_line, sql, word_count
from deskgraph.plans.registry import query
from deskgraph.plans.scoring_queries import message_sql, route_sql
from deskgraph.plans.vector_queries import PATTERNS, _labelled_pairs, first_match_sql
from deskgraph.session import shared_folder
from deskgraph.sources import readers, writers
from deskgraph.streaming import scoring as stream

_ALL = "tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id"


@query("scan_csv_messages", sql(f"SELECT {_ALL} FROM msgs"))
def _(spark, sf):
    path = shared_folder(spark, "csv")
    t.messages(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return readers.scan_csv_messages(spark, path)


@query("scan_csv_pruned", sql("SELECT tweet_id, inbound FROM msgs"))
def _(spark, sf):
    path = shared_folder(spark, "csv")
    t.messages(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return readers.scan_pruned(readers.scan_csv_messages(spark, path), ["tweet_id", "inbound"])


@query("scan_jsonl_limit", gold_sql("SELECT * FROM annotated ORDER BY example_id LIMIT 150"))
def _(spark, sf):
    path = shared_folder(spark, "gold")
    writers.sink_jsonl(golden(spark, sf), path)
    return readers.scan_jsonl_limit(spark, path, limit=150)


@query(
    "scan_json_document",
    _scored_sql(
        "SELECT (SELECT brand FROM composed ORDER BY composite_score DESC, brand LIMIT 1) AS winner, (SELECT brand FROM composed ORDER BY composite_score DESC, brand LIMIT 1 OFFSET 1) AS runner_up"
    ),
)
def _(spark, sf):
    path = shared_folder(spark, "winner")
    ranking = brands.brand_ranking(brands.brand_scores(t.messages(spark, sf)))
    writers.sink_report_json(ranking.where(F.col("rank") == 1).select("winner", "runner_up"), path)
    return readers.scan_json_document(spark, path, "winner string, runner_up string")


@query("scan_json_entries", "SELECT lang AS cache_key, count(*) AS entry FROM documents GROUP BY lang")
def _(spark, sf):
    path = shared_folder(spark, "entries")
    counts = profile.value_counts(t.table(spark, sf, "documents"), "lang")
    packed = counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("value", "n")))).alias("entries"))
    writers.sink_report_json(packed, path)
    document = readers.scan_json_document(spark, path, "entries string")
    return readers.keyed_entries(document, "entries", "bigint")


@query("sink_working_set", WORKING_SQL)
def _(spark, sf):
    path = shared_folder(spark, "working-set")
    rows = working_set(spark, sf)
    writers.sink_working_set(rows, path)
    return spark.read.parquet(path).select(*rows.columns)


@query("sink_jsonl", gold_sql("SELECT * FROM annotated"))
def _(spark, sf):
    path = shared_folder(spark, "gold")
    writers.sink_jsonl(golden(spark, sf), path)
    return readers.scan_jsonl_limit(spark, path, limit=None)


@query(
    "sink_report_json",
    sql(
        """SELECT count(*) AS row_count, CAST(7 AS BIGINT) AS column_count, count(text) - count(DISTINCT text) AS exact_duplicate_texts,
        count(in_response_to_tweet_id) AS has_parent, count(*) FILTER (inbound) AS inbound_rows,
        count(*) - count(response_tweet_id) AS missing_response FROM msgs"""
    ),
)
def _(spark, sf):
    path = shared_folder(spark, "report")
    report = profile.inspection_report(t.messages(spark, sf))
    writers.sink_report_json(report, path)
    return readers.scan_json_document(spark, path, report.schema).select(
        "row_count",
        "column_count",
        "exact_duplicate_texts",
        "threading.has_parent",
        F.col("inbound_distribution")["true"].alias("inbound_rows"),
        F.col("missing_values")["response_tweet_id"].alias("missing_response"),
    )


@query(
    "sink_telemetry_append",
    sql(
        "SELECT CASE WHEN edge_case_category = 'standard' THEN '2024-01-01' ELSE '2024-01-02' END AS run_date, example_id, routing_decision, routing_reason FROM ("
        + route_sql(
            "route_in", "*", "intent", "retrieval_similarity", "edge_case_category", "raw_text", list(D.MANDATORY_INTENTS)
        ).replace(", composite_confidence\n", "\n", 1)
        + ")"
    ),
)
def _(spark, sf):
    path = shared_folder(spark, "telemetry")
    done = routing.route_decision(t.route_inputs(t.gold(spark, sf)))
    standard = F.col("edge_case_category") == "standard"
    for day, rows in (("2024-01-01", done.where(standard)), ("2024-01-02", done.where(~standard))):
        for _attempt in range(2):  # a repeated run leaves one copy
            writers.sink_telemetry_append(rows.select("example_id", "routing_decision", "routing_reason"), path, day, "nightly")
    schema = "example_id bigint, routing_decision string, routing_reason string, run_date string, run_id string"
    return spark.read.schema(schema).json(path).drop("run_id")


@query("model_persist", sql("SELECT brand_tweet_id AS case_id, true AS same FROM clean_pairs"))
def _(spark, sf):
    path = shared_folder(spark, "model")
    train = _labelled_pairs(spark, sf)
    model = baselines.logistic_intent(train)
    writers.save_model(model, f"{path}/model")
    train.drop("pseudo_intent").write.parquet(f"{path}/corpus")
    rows = spark.read.parquet(f"{path}/corpus")
    fresh = baselines.classify_logistic(model, rows).select("case_id", F.col("predicted_intent").alias("_fresh"))
    loaded = baselines.classify_logistic(readers.load_model(f"{path}/model"), rows)
    return loaded.join(fresh, "case_id").select("case_id", (F.col("predicted_intent") == F.col("_fresh")).alias("same"))



# --------------------------------------------------------------------- streams

_CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
_EDGE = f"""CASE WHEN {has_word('clean_text', 'lawyer|attorney|sue|court|police|cops|assault|accident|crash|illegal|harass|danger|threaten|hospital')} THEN 'safety_legal_escalate'
    WHEN {has_words_in_line('clean_text', 'love|great|wonderful|fantastic|fun|awesome', 'wait|charging|charge|broken|delay|late|horrible|terrible|useless|stole')} THEN 'sarcasm_implicit_dissatisfaction'
    WHEN {word_count('clean_text')} <= 4 THEN 'low_info_vague' ELSE 'standard' END"""
_STREAMED = f"""SELECT conv_id, turn, clean_text, {first_match_sql('clean_text')} AS predicted_intent, {_EDGE} AS edge_category
    FROM (SELECT conv_id, turn, {message_sql('text')} AS clean_text FROM conversations)"""


def _incoming(spark, sf):
    return stream.read_messages(spark, f"{sf.rstrip('/')}/conversation*.parquet", _CONVERSATIONS)


@query("stream_telemetry", _STREAMED)
def _(spark, sf):
    path = shared_folder(spark, "stream")
    scored = stream.stream_score_messages(_incoming(spark, sf), patterns=PATTERNS).select(
        "conv_id", "turn", "clean_text", "predicted_intent", "edge_category"
    )
    stream.stream_telemetry(scored, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(scored.schema).json(f"{path}/log")
