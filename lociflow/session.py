"""SparkSession factory for local work and tests; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "lociflow", cores: str | int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution; ``cores`` defaults to every core of the machine."""
    return (
        SparkSession.builder.appName(name)
        .master(f"local[{cores or os.environ.get('BENCH_CPUS', '*')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the supplied parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
