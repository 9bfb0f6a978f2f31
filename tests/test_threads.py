from __future__ import annotations

import random

from pyspark.sql import functions as F

from deskgraph.operators import threads


def context_of(rows, **options):
    done = threads.bounded_context(rows, **options)
    return {(r["conv_id"], r["turn"]): ([t["text"] for t in r["prior_turns"]], r["total_turns"]) for r in done.collect()}


def test_last_turns_in_order(spark):
    rows = spark.createDataFrame([(1, i, "customer" if i % 2 else "agent", f"t{i}") for i in range(1, 6)], "conv_id long, turn long, role string, text string")
    got = context_of(rows, n=2)
    assert got[(1, 1)] == ([], 1)
    assert got[(1, 5)] == (["t3", "t4"], 3)
    assert context_of(rows, n=4)[(1, 4)] == (["t1", "t2", "t3"], 4)


def test_chunks_give_the_same_context_as_one_window(spark):
    rng = random.Random(1)
    data = [(0, t, "customer", f"h{t}") for t in sorted(rng.sample(range(5000), 400))]  # one hot conversation
    data += [(c, t, "agent", f"{c}.{t}") for c in range(1, 30) for t in sorted(rng.sample(range(40), rng.randint(1, 9)))]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    expected = {}
    for conv in {d[0] for d in data}:
        turns = sorted((t, x) for c, t, _, x in data if c == conv)
        for i, (t, _) in enumerate(turns):
            prior = [x for _, x in turns[max(0, i - 3) : i]]
            expected[(conv, t)] = (prior, len(prior) + 1)
    for chunk in (1, 7, 100, 10_000):
        assert context_of(rows, n=3, chunk=chunk) == expected


def test_given_turns_get_defaults_and_a_transcript(spark):
    rows = spark.sql(
        f"""SELECT cast(array(named_struct('role', 'agent', 'text', 'a', 'tweet_id', null, 'created_at', null),
        named_struct('role', 'customer', 'text', 'b', 'tweet_id', 5, 'created_at', 'x')) as {threads.TURN_TYPE}) AS turns, 'now' AS text
        UNION ALL SELECT cast(null as {threads.TURN_TYPE}), 'alone'"""
    )
    got = rows.select(
        threads.thread_transcript(threads.last_turns(F.col("turns"), 4), F.col("text")).alias("t"),
        threads.turn_position(F.col("turns")).alias("p"),
        F.size(threads.last_turns(F.col("turns"), 1)).alias("n"),
    ).collect()
    assert got[0]["t"] == "Support Agent: a\nCustomer: b\nCustomer (Current): now"
    assert (got[0]["p"], got[1]["p"], got[0]["n"], got[1]["n"]) == ("follow_up", "first_turn", 1, 0)
    assert got[1]["t"] == "Customer (Current): alone"


def test_missing_role_and_text_get_defaults(spark):
    rows = spark.createDataFrame([(1, 1, None, None), (1, 2, "agent", "x")], "conv_id long, turn long, role string, text string")
    turns = threads.bounded_context(rows).where("turn = 2").first()["prior_turns"]
    assert (turns[0]["role"], turns[0]["text"]) == ("customer", "")
