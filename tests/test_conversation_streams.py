"""Keyed conversation state: contexts equal to the batch's, bounded state, restarts, repeated and late turns."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

from deskgraph.operators import threads
from deskgraph.streaming import conversations
from deskgraph.streaming import scoring as stream

MESSAGES = "conv_id long, turn long, role string, text string"
SHAPE = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])


class OneValue:
    """A state store of one value."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, shape, ttlDurationMs=None):  # noqa: N802, N803
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def processor(n, held):
    one = conversations.LastTurns(SHAPE, "turn", "role", "text", n, held, 1000)
    store = OneValue()
    one.init(store)
    return one, store


def message(turn, text=None):
    return Row(conv_id=1, turn=turn, role="user", text=text or f"t{turn}")


@given(st.integers(1, 30), st.integers(1, 5), st.integers(0, 8), st.data())
@settings(max_examples=150, deadline=None)
def test_last_output_has_the_context_of_the_batch(size, n, spare, data):
    held = n + spare
    # a turn moves back by at most ``spare`` places, so that it comes before more than ``held`` later ones do
    arrivals = sorted(range(size), key=lambda t: t + data.draw(st.integers(0, spare)))
    repeats = data.draw(st.lists(st.sampled_from(arrivals), max_size=4))
    one, store = processor(n, held)
    last, at = {}, 0
    while at < len(arrivals):
        step = data.draw(st.integers(1, 6))
        batch = [message(t) for t in arrivals[at : at + step]]
        held_now = {t[1] for t in store.value[0]} if store.value else set()
        batch += [message(t) for t in repeats if t in held_now]
        for row in one.handleInputRows((1,), iter(batch), None):
            assert not row.late
            last[row.turn] = [t[1] for t in row.prior_turns]
            assert row.total_turns == len(row.prior_turns) + 1
        assert len(store.value[0]) <= held
        at += step
    assert last == {t: [f"t{b}" for b in range(max(0, t - n), t)] for t in range(size)}


def test_turns_behind_the_kept_ones_go_out_late_and_change_nothing():
    one, store = processor(2, 2)
    list(one.handleInputRows((1,), iter([message(t) for t in (3, 4, 5)]), None))
    before = store.value
    (row,) = one.handleInputRows((1,), iter([message(2)]), None)
    assert row.late and row.prior_turns == [] and store.value == before
    # a held turn that comes again is no news
    assert list(one.handleInputRows((1,), iter([message(5), message(4)]), None)) == [] and store.value == before


def test_missing_orders_and_texts_have_a_place():
    one, _ = processor(2, 4)
    rows = list(one.handleInputRows((None,), iter([message(0), Row(conv_id=None, turn=None, role=None, text=None)]), None))
    assert [(r.turn, r.prior_turns) for r in rows] == [(None, []), (0, [("customer", "", None, None)])]


def put(spark, path, rows):
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(path)


def test_stream_over_files_out_of_order_with_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(c, t, "user" if t % 2 == 0 else "agent", f"{c}/{t}") for c in (1, 2, None) for t in range(9)]

    def run():
        incoming = stream.read_messages(spark, source, MESSAGES, files_per_batch=1)
        conversations.score_conversations(incoming, lambda batch: batch, out, state, held=9).awaitTermination()

    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", None)
    for part in ([r for r in rows if r[1] % 3 == 2], [r for r in rows if r[1] % 3 == 0]):
        put(spark, source, part)
    run()
    put(spark, source, [r for r in rows if r[1] % 3 != 2])  # the second file's turns come once more
    run()  # from the checkpoint
    got = {(r["conv_id"], r["turn"]): [t["text"] for t in r["prior_turns"]] for r in conversations.latest(spark, out, ["conv_id", "turn"]).collect()}
    batch = threads.bounded_context(spark.createDataFrame(rows, MESSAGES)).collect()
    assert got == {(r["conv_id"], r["turn"]): [t["text"] for t in r["prior_turns"]] for r in batch}
    versions = spark.read.parquet(out)
    assert versions.select("batch_id").distinct().count() == 3 and versions.where("late = 'true'").count() == 0
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", None) == before


def test_late_turns_are_scored_once_and_never_replace_others(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        incoming = stream.read_messages(spark, source, MESSAGES, files_per_batch=1)
        conversations.score_conversations(incoming, lambda batch: batch, out, state, n=1, held=1).awaitTermination()

    put(spark, source, [(1, t, "user", str(t)) for t in range(1, 5)])
    run()
    put(spark, source, [(1, 0, "user", "0"), (1, 2, "user", "2")])
    run()
    got = {r["turn"]: [t["text"] for t in r["prior_turns"]] for r in conversations.latest(spark, out, "turn").collect()}
    assert got == {0: [], 1: [], 2: ["1"], 3: ["2"], 4: ["3"]}
