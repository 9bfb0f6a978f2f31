"""Session helpers: a configured builder and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "deskgraph", settings: dict[str, str] | None = None
) -> SparkSession:
    """Session for tests and benchmarks.  On a cluster, submit with its own settings instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DESKGRAPH_DRIVER_MEMORY", "12g"))
    )
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    It lies under ``spark.checkpoint.dir`` as the cluster names it.  Only a local
    session without that setting (a test) gets a temporary folder; on a cluster
    a missing setting is an error, since executors cannot share a local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="deskgraph-")
    return f"{base.rstrip('/')}/deskgraph/{purpose}-{uuid.uuid4().hex}"


def materialise(rows: DataFrame, purpose: str) -> DataFrame:
    """Write ``rows`` to the shared folder once and read them back.

    Cuts the lineage where a result is read several times; the files outlive any executor.
    """
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
