"""Reliable intermediate storage: results that several jobs read are written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private folder only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="lurescan-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stable(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows read back from a written Parquet table.

    Cuts the lineage, survives lost executors, and is columnar, so later jobs read only what they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows of a stored table in a task per ``rows`` of them, if that is more tasks than one."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df
