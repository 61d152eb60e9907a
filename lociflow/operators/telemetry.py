"""Server events: intervals, throttling, retention, storage figures and versioned objects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(events: DataFrame, most_seconds: float, by: str = "user_id") -> DataFrame:
    """Seconds since the source's event before, null for the first and above ``most_seconds``."""
    before = F.lag("ts").over(Window.partitionBy(by).orderBy("ts", "event_id"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.select("event_id", by, F.when(gap <= most_seconds * 1_000_000, F.round(gap / 1_000_000, 6)).alias("gap_s"))


def throttled(events: DataFrame, least_seconds: float, by: str = "user_id") -> DataFrame:
    """Events that are stored if a source stores one only when ``least_seconds`` have passed since its last stored one.

    Each decision depends on the last one, so that one source's events run through in order; several sources share a task.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        rows, last = [], None
        for i, t in enumerate(pdf["ts"]):
            if last is None or (t - last).total_seconds() >= least_seconds:
                rows.append(i)
                last = t
        return pdf.iloc[rows]

    return events.select("event_id", by, "ts").groupBy(by).applyInPandas(keep, events.select("event_id", by, "ts").schema)


def retained(events: DataFrame, days: int) -> DataFrame:
    """Events of the last days before the newest one."""
    newest = events.agg(F.max("ts").alias("newest"))
    return events.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.make_dt_interval(F.lit(days))).drop("newest")


def recent(events: DataFrame, most: int, event_type: str | None = None) -> DataFrame:
    """The newest events, newest first and numbered from 1; the type is filtered before the limit."""
    rows = events if event_type is None else events.where(F.col("event_type") == event_type)
    rows = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id")))).select("rank", "event_id", "event_type")


def long_form(rows: DataFrame, ids: list[str], values: list[str], start: str = "") -> DataFrame:
    """Wide telemetry as (ids, description, value), without nulls and only descriptions with a prefix."""
    return rows.unpivot(ids, values, "description", "value").where(F.col("value").isNotNull() & F.col("description").startswith(start))


def storage_ratio(degree: DataFrame, samples: DataFrame) -> DataFrame:
    """Edges, by the degrees of the linked samples, samples and edges / (1 + samples)."""
    n = degree.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("n_edges"))
    return n.join(samples.agg(F.count("*").alias("n_samples"))).select("n_edges", "n_samples", F.round(F.col("n_edges") / (1 + F.col("n_samples")), 9).alias("ratio"))


def latest_version(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    return versions.withColumn("newest", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("newest = 1").drop("newest")


def newer_than(versions: DataFrame, key: str, version: str, current: int) -> DataFrame:
    """The newest row of each key, if it is newer than the version that the reader has."""
    return latest_version(versions, key, version).where(F.col(version) > current)
