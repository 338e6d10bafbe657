"""Session defaults shared by the command line, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "quern", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` takes underscores for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One fixture table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
