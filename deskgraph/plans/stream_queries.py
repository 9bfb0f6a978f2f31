"""The whole scoring of conversations as they arrive, equal to the batch's."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgraph import defaults as D
from deskgraph.operators.case_index import CaseIndex
from deskgraph.plans import message_scoring, registry
from deskgraph.plans import tables as t
from deskgraph.plans.registry import query
from deskgraph.plans.scoring_queries import SETTINGS, output_text
from deskgraph.plans.vector_queries import fitted
from deskgraph.session import shared_folder
from deskgraph.streaming import conversations
from deskgraph.streaming import scoring as stream

_CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def _scored_stream(spark, sf, incoming):
    """Model and case index are made once; every micro-batch runs all stages over its messages."""
    path = shared_folder(spark, "stream")
    model, vectors = fitted(spark, sf), t.vectors(spark, sf).select("vec_id", "embedding")
    index = CaseIndex.build(t.cases(spark, sf), width=model.values.shape[1], with_cases=True)
    n = vectors.count()

    def score(rows):
        users = rows.where(F.col("role") == "user").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"),
            F.when(F.col("conv_id") % 13 != 6, F.col("text")).alias("input_text"),
            "prior_turns",
            F.lit(D.STANDARD_CATEGORY).alias("edge_category"),
            ((F.col("conv_id") * 8 + F.col("turn")) % n).alias("vec_id"),
        )
        return message_scoring.score_messages(users.join(vectors, "vec_id").drop("vec_id"), model, index, SETTINGS)

    conversations.score_conversations(incoming, score, f"{path}/scored", f"{path}/checkpoint").awaitTermination()
    return output_text(conversations.latest(spark, f"{path}/scored"))


@query("stream_score_messages", registry.ORACLES["scored_messages"])
def _(spark, sf):
    return _scored_stream(spark, sf, stream.read_messages(spark, f"{sf.rstrip('/')}/conversation*.parquet", _CONVERSATIONS))


@query("stream_score_messages_out_of_order", registry.ORACLES["scored_messages"])
def _(spark, sf):
    """The turns of a conversation lie in three files, later ones before earlier ones, one file a micro-batch."""
    path = shared_folder(spark, "arrivals")
    shuffled = t.table(spark, sf, "conversations").withColumn("part", (2 * F.col("turn") + F.col("conv_id")) % 3)
    shuffled.repartition(3, "part").write.parquet(path)
    return _scored_stream(spark, sf, stream.read_messages(spark, path, _CONVERSATIONS, files_per_batch=1))
