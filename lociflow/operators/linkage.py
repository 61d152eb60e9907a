"""Linkage that grows: samples are added to a stored graph, which is clustered, simplified and restored by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.operators import graph
from lociflow.operators.neighbours import induced
from lociflow.sources.io import Store

NODES = "sample_id string, node_id long, is_mixed boolean, detected long"
LINKS = "a string, b string, dist int"


class Linkage:
    """A graph under one folder: nodes numbered in the order in which they came, and their links within the threshold.

    Every addition appends; nothing that is stored is read again but the nodes' ids and largest number. Mixed samples stay in the graph and are left out of clusters by the mode.
    """

    def __init__(self, spark: SparkSession, root: str, threshold: int, mode: str = "ignore"):
        if mode not in graph.MODES:
            raise ValueError(f"unknown way to treat mixed samples: {mode}")
        self.spark, self.store, self.threshold, self.mode = spark, Store(spark, root), threshold, mode

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes", NODES)

    @property
    def links(self) -> DataFrame:
        return self.store.read("links", LINKS).distinct()

    def change_id(self) -> int:
        """The largest number of a node, -1 without any."""
        return self.nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0]

    def add(self, ids: DataFrame, edges: DataFrame, mixed: DataFrame | None = None) -> int:
        """Add the samples that are new, with their links to each other and to all before them; returns the change id, -1 if nothing was added.

        Links are written before the nodes, so that an addition that failed finds its samples missing and writes them again; readers take distinct links.
        """
        old = self.nodes
        new = ids.select("sample_id").distinct().join(old, "sample_id", "left_anti")
        if not new.limit(1).count():
            return -1
        flagged = graph.number_nodes(new, self.change_id() + 1)
        m = (ids.limit(0) if mixed is None else mixed).select("sample_id").distinct().withColumn("m", F.lit(True))
        flagged = flagged.join(m, "sample_id", "left").select("sample_id", "node_id", F.coalesce("m", F.lit(False)).alias("is_mixed"), F.when(F.col("m"), F.col("node_id")).alias("detected"))
        known = old.select("sample_id").union(flagged.select("sample_id"))
        near = induced(edges.where(F.col("dist") <= self.threshold), known)
        fresh = flagged.select("sample_id")
        touching = near.join(fresh, F.col("a") == F.col("sample_id"), "left_semi").union(near.join(fresh, F.col("b") == F.col("sample_id"), "left_semi")).distinct()
        touching.select("a", "b", "dist").write.mode("append").parquet(self.store.path("links"))
        flagged.write.mode("append").parquet(self.store.path("nodes"))
        return self.change_id()

    def clusters(self) -> DataFrame:
        mixed = None if self.mode == "ignore" else self.nodes.where("is_mixed").select("sample_id")
        return graph.clusters(self.spark, self.nodes.select("sample_id", "node_id"), self.links, self.threshold, mixed, self.mode)

    def persist(self, name: str) -> int:
        """Write the clusters as the newest version under a name, and return the version."""
        version = self.versions(name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        self.clusters().withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(self.store.path(f"{name}-output"))
        return version

    def versions(self, name: str) -> DataFrame:
        return self.store.read(f"{name}-output", OUTPUT).select("version").distinct()

    def refreshed(self, name: str, have: int = 0) -> tuple[int, DataFrame] | None:
        """The newest version and its clusters, or nothing if the reader has it."""
        newest = self.versions(name).agg(F.max("version")).first()[0]
        if newest is None or newest <= have:
            return None
        return newest, self.store.read(f"{name}-output", OUTPUT).where(F.col("version") == newest).drop("version")


OUTPUT = "sample_id string, node_id long, cluster_id long, change_id long, is_mixed boolean, version long"


def with_size(found: DataFrame, samples: DataFrame) -> DataFrame:
    """``(sample_id, cluster_id, examined, cluster_size)`` of every clustered sample."""
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    return found.withColumn("cluster_size", size).join(samples.select("sample_id", "examined"), "sample_id").select("sample_id", "cluster_id", "examined", "cluster_size")


def with_meta(samples: DataFrame, found: DataFrame) -> DataFrame:
    """All samples with their cluster, null where they are in none; an unknown mixture counts as none."""
    return samples.join(found.select("sample_id", "cluster_id", "is_mixed"), "sample_id", "left").withColumn("is_mixed", F.coalesce("is_mixed", F.lit(False)))


def labelled_crosstab(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of each cluster by whether they are mixed, with the cluster's label."""
    return graph.crosstab_mixed(found).join(labels.select("cluster_id", "label"), "cluster_id", "left")


def changes(found: DataFrame, detected: DataFrame, after: int) -> DataFrame:
    """Rows whose cluster changed, or that were found to be mixed, after a change id: the later of both counts."""
    rows = found.join(detected.select("sample_id", "detected"), "sample_id", "left").withColumn("change", F.greatest("change_id", F.coalesce("detected", F.col("change_id"))))
    return rows.where(F.col("change") > after).select("sample_id", "cluster_id", "change", "is_mixed")


def unused(labels: DataFrame, used: DataFrame) -> DataFrame:
    """Labels that no cluster has, in order."""
    return labels.select("label").distinct().join(used.where("label is not null").select("label"), "label", "left_anti").orderBy("label")
