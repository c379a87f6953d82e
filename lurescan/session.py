"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "lurescan", partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """Adaptive execution with skew handling; UTC. On a cluster the caller's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if memory:
        b = b.config("spark.driver.memory", memory)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
