"""Small pieces that several of the operators share."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgraph.session import shared_folder

#: Words are runs of anything but the six ASCII white-space characters.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write ``rows`` to the cluster's shared folder and read them back: cuts lineage, survives lost executors."""
    path = shared_folder(rows.sparkSession, f"llm-{purpose}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fresh(prefix: str) -> str:
    """A column name that no input column can have by accident."""
    return f"_{prefix}_{uuid.uuid4().hex[:8]}"


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker process, across its tasks.

    Task functions are shipped by value, so a plain module variable would start empty in each task.
    Only values that any task may compute anew belong here.  A worker keeps one cache: another name drops it.
    """
    module = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if getattr(module, "name", None) != name:
        module.name, module.held = name, {}
    return module.held
