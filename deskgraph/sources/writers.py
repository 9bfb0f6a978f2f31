"""Sinks.  Each writes distributed files; none gathers rows on the driver."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_working_set(rows: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Working set as Parquet, one folder per split so that reading one pool skips the other.

    Rows stay in the tasks they are in; ``rows_per_file`` bounds a file where a task is large.
    """
    rows.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("split").parquet(path)


def sink_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def report_json(report: DataFrame, name: str = "report") -> DataFrame:
    """A report row as one JSON text."""
    return report.select(F.to_json(F.struct("*")).alias(name))


def sink_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row report as a JSON file."""
    report.coalesce(1).write.mode(mode).json(path)


def sink_telemetry_append(rows: DataFrame, path: str, run_date: str, run_id: str | None = None) -> None:
    """Add execution records under the folder of their run date and run.

    The same ``run_id`` on the same date replaces what an earlier attempt of that run left, so a run that is repeated leaves one
    copy; other runs are not touched.  Without a ``run_id`` every call is a run of its own.  A repeat without rows changes nothing.
    """
    told = rows.withColumn("run_date", F.lit(run_date)).withColumn("run_id", F.lit(run_id or uuid.uuid4().hex))
    writer = told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date", "run_id").json(path)


def merged_predictions(cached: DataFrame, scored: DataFrame) -> DataFrame:
    """Cached predictions plus freshly scored ones."""
    return cached.select(*scored.columns).unionByName(scored)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
