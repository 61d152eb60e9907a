"""Samples that arrive as a stream: compressed, stored once, compared with all before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import codec
from lociflow.operators import distance
from lociflow.sources.io import Store

SAMPLES = "sample_id string, invalid int"
VARIANTS = "sample_id string, pos int, base string"
UNKNOWNS = "sample_id string, pos int, kind string, code string"
EDGES = "a string, b string, dist int"


def insert_batch(store: Store, batch: DataFrame, reference: str, mask: tuple[int, ...], max_unknown: int, ceiling: int) -> int:
    """Store a batch ``(sample_id, seq)`` and its edges to itself and to everything stored, without comparing what is stored again; known ids are ignored. Returns the number of new samples.

    Edges and differences are written before the samples, so that a batch that is repeated after a failure finds its samples missing and writes all again; readers take distinct rows.
    """
    old = store.read("samples", SAMPLES)
    fresh = batch.dropDuplicates(["sample_id"]).join(old.select("sample_id"), "sample_id", "left_anti").persist()
    try:
        samples, variants, unknowns = codec.compress(fresh, reference, mask, max_unknown)
        n = fresh.count()
        if not n:
            return 0
        new = samples.where("invalid = 0").select("sample_id")
        known = old.where("invalid = 0").select("sample_id").union(new)
        all_v = store.read("variants", VARIANTS).distinct().union(variants)
        all_u = store.read("unknowns", UNKNOWNS).distinct().union(unknowns)
        found = distance.new_edges(known, new, all_v, all_u, ceiling)
        found.write.mode("append").parquet(store.path("edges"))
        variants.write.mode("append").parquet(store.path("variants"))
        unknowns.write.mode("append").parquet(store.path("unknowns"))
        samples.write.mode("append").parquet(store.path("samples"))
        return n
    finally:
        fresh.unpersist()


def ingest(spark: SparkSession, stream: DataFrame, root: str, reference: str, mask: tuple[int, ...], max_unknown: int, ceiling: int, checkpoint: str, **trigger):
    """Run ``insert_batch`` on every micro-batch of a stream ``(sample_id, seq)``; returns the started query."""
    store = Store(spark, root)
    each = lambda batch, _: insert_batch(store, batch, reference, mask, max_unknown, ceiling)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_edges(store: Store) -> DataFrame:
    return store.read("edges", EDGES).distinct()


def repaired_edges(store: Store, reference_edges: DataFrame) -> DataFrame:
    """Edges that ought to be stored and aren't."""
    return reference_edges.join(stored_edges(store), ["a", "b", "dist"], "left_anti")


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window, for streams with events that come late by at most ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
