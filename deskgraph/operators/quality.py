"""Data-quality checks that return their findings as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgraph.functions.numeric import count_if
from deskgraph.functions.text import is_blank

WORKING_SET_COLUMNS = (
    "brand",
    "customer_tweet_id",
    "customer_author",
    "customer_text_clean",
    "brand_tweet_id",
    "brand_reply_clean",
    "split",
)
GOLD_COLUMNS = (
    "example_id",
    "customer_tweet_id",
    "customer_text",
    "gold_intent",
    "gold_routing_decision",
    "gold_reply_reference",
)
ACTIONS = ("AUTO_HANDLE", "ESCALATE")


def dq_required_columns(rows: DataFrame, required: Sequence[str] = WORKING_SET_COLUMNS) -> DataFrame:
    """One row per required column, whether it is there, and how many rows carry a value in it."""
    present = set(rows.columns)
    filled = rows.agg(*[(F.count(F.col(c)) if c in present else F.count(F.lit(None))).alias(c) for c in required])
    return filled.unpivot([], list(required), "column_name", "filled_rows").select(
        "column_name", F.col("column_name").isin(*present).alias("present"), "filled_rows"
    )


def dq_null_blank(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and blank counts of each column."""
    counted = rows.agg(
        *[
            F.struct(
                count_if(F.col(c).isNull()).alias("null_rows"),
                count_if(F.col(c).isNotNull() & is_blank(F.col(c).cast("string"))).alias("blank_rows"),
            ).alias(c)
            for c in columns
        ]
    )
    return counted.unpivot([], list(columns), "column_name", "c").select("column_name", "c.null_rows", "c.blank_rows")


def dq_volume_range(rows: DataFrame, low: int = 150, high: int = 250) -> DataFrame:
    """Row count and whether it lies within the range."""
    return rows.agg(F.count(F.lit(1)).alias("row_count")).withColumn("in_range", F.col("row_count").between(low, high))


def dq_allowed_values(rows: DataFrame, column: str, allowed: Sequence[str] = ACTIONS) -> DataFrame:
    """Values outside the allowed set, ignoring case, with their counts; no row means none."""
    value = F.upper(F.col(column).cast("string"))
    return (
        rows.where(~F.coalesce(value.isin(*allowed), F.lit(False)))
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
