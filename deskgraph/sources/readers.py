"""Readers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskgraph.sources import csv_records

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.LongType()),
    ]
)
GOLD_SCHEMA = T.StructType(
    [
        T.StructField("example_id", T.StringType()),
        T.StructField("customer_tweet_id", T.LongType()),
        T.StructField("customer_text", T.StringType()),
        T.StructField("turn_position", T.StringType()),
        T.StructField("length_bucket", T.StringType()),
        T.StructField("edge_case_category", T.StringType()),
        T.StructField("gold_intent", T.StringType()),
        T.StructField("gold_routing_decision", T.StringType()),
        T.StructField("gold_escalate_reason", T.StringType()),
        T.StructField("gold_reply_reference", T.StringType()),
        T.StructField("brand_historical_reply", T.StringType()),
    ]
)


def scan_csv_messages(
    spark: SparkSession, path: str, schema: T.StructType = MESSAGE_SCHEMA, max_rows: int | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Messages from CSV with a header.

    Files are read in splits, also where a quoted text holds a line break (see :mod:`deskgraph.sources.csv_records`);
    one pass over the lines finds that out.  With ``multi_line`` Spark reads each file as one.
    """
    rows = csv_records.read_records(spark, path, schema) if multi_line is None else None
    if rows is None:
        rows = _csv(spark, path, schema, bool(multi_line))
    return rows if max_rows is None else rows.limit(max_rows)


def _csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def scan_pruned(rows: DataFrame, columns: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Only the named columns; the scan reads no others."""
    kept = rows.select(*columns)
    return kept if max_rows is None else kept.limit(max_rows)


def scan_jsonl_limit(
    spark: SparkSession, path: str, schema: T.StructType = GOLD_SCHEMA, key: str = "example_id", limit: int | None = 200
) -> DataFrame:
    """JSON lines without the blank ones, the first ``limit`` by ``key``.

    Files have no order in Spark, so the limit follows the key.
    """
    rows = spark.read.schema(schema).json(path).where(F.col(key).isNotNull())
    return rows if limit is None else rows.orderBy(key).limit(limit)


def scan_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per file, read whole."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_entries(documents: DataFrame, column: str, value_type: str, key: str = "cache_key", value: str = "entry") -> DataFrame:
    """A JSON object of keyed entries, held as text, as one row per key."""
    parsed = F.from_json(F.col(column), f"map<string,{value_type}>")
    return documents.select(F.explode(parsed).alias(key, value))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
