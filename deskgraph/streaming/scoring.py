"""Scoring of messages as they arrive, and their log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from deskgraph import defaults as D
from deskgraph.functions import rules
from deskgraph.functions import text as T
from deskgraph.operators import threads


def read_messages(spark: SparkSession, path: str, schema: StructType | str, file_format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of new files of a folder or glob."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_score_messages(
    messages: DataFrame, text: str = "text", brand: str = D.BRAND_HANDLE, patterns: dict[str, str] | None = None
) -> DataFrame:
    """Row-wise scoring: clean text, keyword intent, edge category and keyword route.  Keeps no state."""
    clean = F.col("clean_text")
    labelled = (
        messages.withColumn("clean_text", T.normalize_message(F.col(text), brand))
        .withColumn("predicted_intent", rules.keyword_first_match(clean, patterns or D.INTENT_PATTERNS))
        .withColumn("edge_category", rules.edge_category(clean))
    )
    return rules.keyword_escalation(labelled, "clean_text")


def stream_telemetry(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every result once: the file sink's log makes a restart skip what was written."""
    writer = scored.writeStream.format("json").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_batches(
    messages: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run any batch scoring on each micro-batch, for steps a stream cannot hold (ranks, context).

    A batch overwrites its own folder, so a batch that is run again leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def context_from_history(batch: DataFrame, history: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """The batch with ``prior_turns`` drawn from stored messages and from the batch itself.

    Only stored messages of the batch's conversations are read into the windows; a message that
    is already stored counts once.
    """
    known = history.join(batch.select(conversation).distinct(), conversation, "left_semi").join(
        batch.select(conversation, order), [conversation, order], "left_anti"
    )
    both = known.select(*batch.columns).withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)))
    return threads.bounded_context(both, conversation, order).where("_new").drop("_new")
