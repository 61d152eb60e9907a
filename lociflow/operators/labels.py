"""Labels of clusters: series of new ones, versions, and carrying old ones over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.codec import label_decode, label_encode


def carried(found: DataFrame, previous: DataFrame) -> DataFrame:
    """``(cluster_id, label)``: the smallest of the labels that a cluster's members had; a label claimed by several clusters gets a version for each.

    Versions follow the clusters' ids; null where no member had a label. Old version suffixes are dropped first.
    """
    base = F.regexp_replace("label", "v[0-9]+$", "")
    old = found.join(previous.select("sample_id", base.alias("label")), "sample_id", "left").groupBy("cluster_id").agg(F.min("label").alias("base"))
    w = Window.partitionBy("base")
    label = F.when(F.col("base").isNull(), None).when(F.count("*").over(w) == 1, F.col("base")).otherwise(F.concat("base", F.lit("v"), F.row_number().over(w.orderBy("cluster_id")).cast("string")))
    return old.select("cluster_id", label.alias("label"))


def assigned(found: DataFrame, previous: DataFrame, smallest: int = 2) -> DataFrame:
    """Labels of all clusters of at least ``smallest`` members: carried over, or new ones after the highest so far, in order of cluster_id."""
    big = found.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= smallest).select("cluster_id")
    known = carried(found.join(big, "cluster_id", "left_semi"), previous)
    top = previous.agg(F.coalesce(F.max(label_decode(F.col("label"))), F.lit(0)).alias("top"))
    new = known.where("label is null").withColumn("i", F.row_number().over(Window.orderBy("cluster_id"))).join(F.broadcast(top))
    return known.where("label is not null").union(new.select("cluster_id", label_encode(F.col("top") + F.col("i"))))


def check_one_to_one(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``(problem, value)``: labels of several clusters, clusters with several labels, and labelled clusters that don't exist; empty if all is well."""
    pairs = labels.select("cluster_id", "label").distinct()
    many = pairs.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("label of several clusters").alias("problem"), F.col("label").alias("value"))
    more = pairs.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("cluster with several labels").alias("problem"), F.col("cluster_id").cast("string").alias("value"))
    gone = pairs.join(found.select("cluster_id").distinct(), "cluster_id", "left_anti").select(F.lit("no such cluster").alias("problem"), F.col("cluster_id").cast("string").alias("value"))
    return many.union(more).union(gone)
