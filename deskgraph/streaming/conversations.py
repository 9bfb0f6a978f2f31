"""Conversations on a stream: the last turns of each in keyed state, and the whole scoring of what arrives."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from deskgraph import defaults as D
from deskgraph.operators.threads import TURN_TYPE
from deskgraph.session import materialise

#: Turns of a conversation that are kept; the context of a message is final once so many later ones have come.
HELD_TURNS = 16
#: Conversations without a new turn for so long are dropped from state.
IDLE_MILLISECONDS = 7 * 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastTurns(StatefulProcessor):
    """State of a conversation: its last ``held`` turns by order, and the highest order that no longer is among them.

    A new turn is put in its place.  It goes out with the turns before it, and so does every kept turn after it whose context it
    changes, so the last output of a turn has the context a batch over all turns would give.
    """

    def __init__(self, schema: StructType, order: str, role: str, text: str, n: int, held: int, idle_ms: int):
        self.schema, self.order, self.role, self.text = schema, order, role, text
        self.n, self.held, self.idle_ms = n, held, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        shape = StructType([StructField("turns", ArrayType(self.schema)), StructField("passed", LongType()), StructField("dropped", BooleanType())])
        self.state = handle.getValueState("last_turns", shape, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        turns = [Row(**dict(zip(self.schema.names, t, strict=True))) for t in held[0]] if held else []
        passed, dropped = (held[1], held[2]) if held else (None, False)
        place = lambda r: (r[self.order] is not None, r[self.order] or 0)  # noqa: E731  as Spark sorts: null first
        known, late, new = {place(t) for t in turns}, [], []
        for row in rows:
            at = place(row)
            if dropped and at <= (passed is not None, passed or 0):
                late.append(row)
            elif at not in known:  # an order that is there came twice
                known.add(at)
                new.append(row)
        fresh = {place(r) for r in new}
        turns = sorted([*turns, *new], key=place)
        for row in late:  # too late to have its place: without a context, and marked
            yield self.output(row, [], True)
        for i, row in enumerate(turns):
            before = turns[max(0, i - self.n) : i]
            if place(row) in fresh or any(place(b) in fresh for b in before):
                yield self.output(row, before, False)
        if new:
            if len(turns) > self.held:
                passed, dropped = turns[-self.held - 1][self.order], True
            kept = [tuple(t[c] for c in self.schema.names) for t in turns[-self.held :]]
            self.state.update((kept, passed, dropped))

    def output(self, row: Row, before: list[Row], late: bool) -> Row:
        prior = [(b[self.role] or "customer", b[self.text] or "", None, None) for b in before]
        return Row(**{c: row[c] for c in self.schema.names}, prior_turns=prior, total_turns=len(prior) + 1, late=late)

    def close(self) -> None:
        pass


def stream_context(
    messages: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    n: int = D.CONTEXT_TURNS,
    held: int = HELD_TURNS,
    idle_ms: int = IDLE_MILLISECONDS,
) -> DataFrame:
    """A stream of messages with ``prior_turns``, ``total_turns`` and ``late``; a message goes out again when its context changes.

    Contexts come from keyed state, not from stored history.  ``held`` (at least ``n``) bounds the state of a
    conversation, ``idle_ms`` its life.  Turns may arrive in any order within ``held`` turns; one that comes
    after its place has left the state goes out once, ``late``, without context.  A turn that arrives again while
    it is held changes nothing.  A micro-batch sorts each of its conversations in one task, so bound its files.
    The query needs the state store of :func:`stream_settings`.
    """
    if held < n:
        raise ValueError("held must not be below n")
    inner = StructType([StructField(f.name, f.dataType) for f in messages.schema])
    prior = messages.sparkSession.createDataFrame([], f"p {TURN_TYPE}").schema["p"].dataType
    shape = StructType([*inner, StructField("prior_turns", prior), StructField("total_turns", LongType()), StructField("late", BooleanType())])
    processor = LastTurns(inner, order, role, text, n, held, idle_ms)
    return messages.groupBy(conversation).transformWithState(processor, shape, "Update", "ProcessingTime")


@contextmanager
def stream_settings(spark: SparkSession, available_now: bool) -> Iterator[None]:
    """What a query over :func:`stream_context` needs when it starts: a state store off the heap, and an end when input ends.

    State with a life time asks for batches without data for ever, so a run over what is there now goes without them.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if available_now:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def score_conversations(
    messages: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
    **context,
) -> StreamingQuery:
    """Run ``score`` over every message with its context, as messages arrive.

    ``score`` gets stored rows with the messages' columns, ``prior_turns`` and ``total_turns``, and is free to read them several
    times.  Each micro-batch overwrites its own folders, so one that is run again after a failure leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialise(batch, "micro-batch")
        score(rows.where(~F.col("late")).drop("late")).write.mode("overwrite").parquet(f"{path}/late=false/batch_id={batch_id}")
        late = rows.where("late").drop("late")
        if not late.isEmpty():
            score(late).write.mode("overwrite").parquet(f"{path}/late=true/batch_id={batch_id}")

    writer = stream_context(messages, **context).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with stream_settings(messages.sparkSession, available_now):  # a query keeps the settings it starts with
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, key: str | Sequence[str] = "example_id") -> DataFrame:
    """The last version of every scored message; one scored late, without its context, counts only where there is no other."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = spark.read.parquet(path)
    # a message has few versions: one for each turn before it that came after it
    newest = Window.partitionBy(*keys).orderBy(F.col("late").cast("boolean"), F.desc("batch_id"))
    return rows.withColumn("_version", F.row_number().over(newest)).where("_version = 1").drop("_version", "batch_id", "late")
