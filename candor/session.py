"""Session construction and table access shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "candor", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results rely on (UTC) and adaptive execution on.

    On a cluster leave ``master`` and ``partitions`` unset: the submit command and adaptive coalescing decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
