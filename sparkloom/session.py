"""The session and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "sparkloom", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive plans; everything else is the cluster's to set."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
