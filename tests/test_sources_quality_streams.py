from __future__ import annotations

import json

from pyspark.sql import functions as F

from deskgraph.operators import corpus, profile, quality, sampling
from deskgraph.plans import tables
from deskgraph.sources import readers, writers
from deskgraph.streaming import scoring as stream
from tests.conftest import SMALL


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        '1,c1,True,now,"a ""quoted""\nline, with comma",2,\n2,acme,False,now,fine,,1\n'
    )
    got = readers.scan_csv_messages(spark, str(path)).orderBy("tweet_id").collect()
    assert got[0]["text"] == 'a "quoted"\nline, with comma' and got[0]["inbound"] is True
    assert got[1]["in_response_to_tweet_id"] == 1 and got[0]["in_response_to_tweet_id"] is None
    assert readers.scan_csv_messages(spark, str(path), max_rows=1).count() == 1


def test_pruned_scan_reads_two_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.messages(spark, SMALL).write.parquet(path)
    pruned = readers.scan_pruned(spark.read.parquet(path), ["tweet_id", "inbound"]).where("tweet_id = 1")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tweet_id:bigint,inbound:boolean>" in plan and "EqualTo(tweet_id,1)" in plan


def test_jsonl_limit_skips_blank_lines(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"example_id": "gold_002", "gold_intent": "b"}\n\n{"example_id": "gold_001", "gold_intent": "a"}\n\n')
    assert [r["example_id"] for r in readers.scan_jsonl_limit(spark, str(path), limit=1).collect()] == ["gold_001"]


def test_split_folders_prune(spark, tmp_path):
    rows = sampling.holdout_split(tables.doc_pairs(spark, SMALL), "customer_tweet_id")
    writers.sink_working_set(rows, str(tmp_path / "w"))
    one = sampling.split_filter(spark.read.parquet(str(tmp_path / "w")), "retrieval_pool")
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 160


def test_telemetry_appends(spark, tmp_path):
    rows = spark.range(3)
    for day in ("d1", "d1", "d2"):
        writers.sink_telemetry_append(rows, str(tmp_path / "t"), day)
    got = spark.read.json(str(tmp_path / "t")).groupBy("run_date").count().collect()
    assert {(r["run_date"], r["count"]) for r in got} == {("d1", 6), ("d2", 3)}


def test_report_is_one_json_object(spark):
    text = writers.report_json(profile.inspection_report(tables.messages(spark, SMALL))).first()["report"]
    report = json.loads(text)
    assert report["row_count"] == tables.messages(spark, SMALL).count()
    assert set(report["inbound_distribution"]) == {"true", "false"}


def test_quality_checks(spark):
    rows = spark.createDataFrame([(1, "a", "Escalate"), (2, " \t", "other"), (None, None, None)], "id long, t string, r string")
    assert {r["column_name"]: (r["present"], r["filled_rows"]) for r in quality.dq_required_columns(rows, ["id", "zz"]).collect()} == {"id": (True, 2), "zz": (False, 0)}
    got = {r["column_name"]: (r["null_rows"], r["blank_rows"]) for r in quality.dq_null_blank(rows, ["id", "t"]).collect()}
    assert got == {"id": (1, 0), "t": (1, 1)}
    assert quality.dq_volume_range(rows, 1, 3).first()["in_range"] is True
    assert {(r["value"], r["n"]) for r in quality.dq_allowed_values(rows, "r").collect()} == {("OTHER", 1), (None, 1)}


def test_terciles_share_buckets_for_equal_lengths(spark):
    rows = spark.createDataFrame([(1,), (1,), (1,), (1,), (5,), (9,)], "customer_char_len long")
    got = [(r[0], r[1]) for r in corpus.tercile_bucket(rows).orderBy("customer_char_len").collect()]
    assert got == [(1, "short")] * 4 + [(5, "long"), (9, "long")]


def test_pair_chain_on_a_small_graph(spark):
    data = [
        (1, "c1", True, "@acme my bag is lost", None),
        (2, "acme", False, "@c1 sorry", 1),
        (3, "acme", False, "@c1 again", 1),
        (4, "acme", False, "gone parent", 99),
        (5, "acme", False, "no parent", None),
        (6, "acme", False, "to self", 2),
        (7, "c2", True, "@ACME my bag is lost", 2),
        (8, "acme", False, "@c2 hi", 7),
    ]
    msgs = spark.createDataFrame(data, "tweet_id long, author_id string, inbound boolean, text string, in_response_to_tweet_id long").withColumn("created_at", F.lit(None).cast("string"))
    funnel = corpus.pair_funnel(msgs, "acme").first().asDict()
    assert funnel == {"brand_replies": 6, "paired": 3, "missing_parent": 1, "non_inbound_parent": 1}
    kept = corpus.clean_pairs(msgs, "acme").collect()
    assert [(r["customer_tweet_id"], r["brand_tweet_id"], r["customer_text_clean"], r["brand_reply_clean"]) for r in kept] == [(1, 2, "@acme my bag is lost", "@customer sorry")]
    assert kept[0]["is_first_turn"] is True and kept[0]["customer_char_len"] == 20
    assert profile.sample_exchanges(msgs).where("customer_tweet_id = 99").first()["customer_text"] == profile.MISSING_PARENT_TEXT


def write_messages(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(path)


def test_stream_appends_each_message_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "conv_id long, turn long, role string, text string"
    for batch in ([(1, 0, "user", "call the Police now please sir")], [(2, 0, "user", "HTTPS://x.y hello")]):
        write_messages(spark, source, batch)
        scored = stream.stream_score_messages(stream.read_messages(spark, source, schema))
        stream.stream_telemetry(scored, out, state).awaitTermination()
    got = {r["conv_id"]: r for r in spark.read.json(out).collect()}
    assert len(got) == spark.read.json(out).count() == 2
    assert got[1]["edge_category"] == "safety_legal_escalate" and got[1]["routing_decision"] == "escalate"
    assert got[2]["clean_text"] == "[URL] hello"


def test_stream_context_comes_from_history(spark, tmp_path):
    source, out, state, store = (str(tmp_path / n) for n in ("in", "out", "state", "store"))
    write_messages(spark, store, [(1, 0, "user", "first"), (1, 1, "agent", "second"), (5, 0, "user", "other")])
    write_messages(spark, source, [(1, 2, "user", "third"), (1, 1, "agent", "second")])
    history = spark.read.parquet(store)

    def score(batch):
        return stream.context_from_history(batch, history)

    incoming = stream.read_messages(spark, source, "conv_id long, turn long, role string, text string")
    stream.stream_batches(incoming, score, out, state).awaitTermination()
    got = {r["turn"]: [t["text"] for t in r["prior_turns"]] for r in spark.read.parquet(out).collect()}
    assert got == {2: ["first", "second"], 1: ["first"]}
