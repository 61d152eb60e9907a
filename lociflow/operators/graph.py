"""Clusters of the thresholded edge graph, with and without mixed samples, their changes and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.operators.components import components
from lociflow.operators.neighbours import induced
from lociflow.scratch import Scratch

MODES = ("ignore", "exclude", "include")


def number_nodes(ids: DataFrame, start: int = 0) -> DataFrame:
    """``(sample_id, node_id)``: consecutive numbers in the order of ids, after ``start`` earlier ones.

    Numbers come from ranges of sorted ids and the sizes of the ranges before them, so that no task sorts all ids.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = Scratch(spark, "nodes").write(ids.select("sample_id").distinct().repartitionByRange(parts, "sample_id").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "offset")
    within = F.row_number().over(Window.partitionBy("part").orderBy("sample_id"))
    return ranged.withColumn("within", within).join(F.broadcast(offsets), "part").select("sample_id", (F.col("offset") + F.col("within") - 1 + start).cast("long").alias("node_id"))


def _numbered(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("sample_id").alias("a"), F.col("node_id").alias("u")), nodes.select(F.col("sample_id").alias("b"), F.col("node_id").alias("v"))
    return edges.join(a, "a").join(b, "b").select("u", "v")


def clusters(spark: SparkSession, nodes: DataFrame, edges: DataFrame, threshold: int, mixed: DataFrame | None = None, mode: str = "ignore") -> DataFrame:
    """``(sample_id, node_id, cluster_id, change_id, is_mixed)``: single linkage at a threshold.

    A cluster's id is its smallest node, its change_id the largest. Mode ignore takes all samples alike; exclude makes mixed samples singletons; include adds each mixed sample to the
    cluster of every unmixed neighbour within the threshold, so that it may have several rows, and leaves it alone if there is none.
    """
    if mode not in MODES:
        raise ValueError(f"unknown way to treat mixed samples: {mode}")
    scratch = Scratch(spark, "graph")
    near = edges.where(F.col("dist") <= threshold)
    flags = nodes.select("sample_id", "node_id")
    flags = flags.withColumn("is_mixed", F.lit(False)) if mixed is None else flags.join(mixed.select("sample_id").distinct().withColumn("m", F.lit(True)), "sample_id", "left").select("sample_id", "node_id", F.coalesce("m", F.lit(False)).alias("is_mixed"))
    linked = near
    if mixed is not None and mode != "ignore":
        m = mixed.select("sample_id").distinct()
        linked = near.join(m, F.col("a") == F.col("sample_id"), "left_anti").join(m, F.col("b") == F.col("sample_id"), "left_anti")
    roots = components(_numbered(linked.where("a < b"), nodes), scratch)
    own = flags.join(roots, flags.node_id == roots.node, "left").select("sample_id", "node_id", "is_mixed", F.coalesce("root", "node_id").alias("cluster_id"))
    if mode == "include" and mixed is not None:
        homes = own.where("not is_mixed").select(F.col("sample_id").alias("b"), "cluster_id")
        joined = near.join(homes, "b").select(F.col("a").alias("sample_id"), "cluster_id").distinct()
        extra = own.where("is_mixed").select("sample_id", "node_id", "is_mixed", F.col("cluster_id").alias("alone")).join(joined, "sample_id", "left")
        own = own.where("not is_mixed").unionByName(extra.select("sample_id", "node_id", "is_mixed", F.coalesce("cluster_id", "alone").alias("cluster_id")))
    last = own.groupBy("cluster_id").agg(F.max("node_id").alias("change_id"))
    return own.join(last, "cluster_id").select("sample_id", "node_id", "cluster_id", "change_id", "is_mixed")


def profile_clusters(spark: SparkSession, nodes: DataFrame, members: DataFrame, links: DataFrame, threshold: int, mixed: DataFrame | None = None, mode: str = "ignore") -> DataFrame:
    """As ``clusters``, from ``members(sample_id, profile)`` and the links of profiles: no step takes more than a profile's or a sample's row, however many pairs of samples are alike.

    Samples of a profile are all mixed or none of them is.
    """
    scratch = Scratch(spark, "profiles")
    own = nodes.select("sample_id", "node_id").join(members, "sample_id")
    if mixed is not None:
        own = own.join(mixed.select("sample_id").distinct().withColumn("m", F.lit(True)), "sample_id", "left")
    own = scratch.write(own if mixed is not None else own.withColumn("m", F.lit(False)))
    heads = scratch.write(own.groupBy("profile").agg(F.min("node_id").alias("node_id"), F.max(F.coalesce("m", F.lit(False))).alias("m")).withColumnRenamed("profile", "sample_id"))
    found = clusters(spark, heads, links.union(links.select("b", "a", "dist")), threshold, None if mixed is None else heads.where("m"), mode)
    found = found.select(F.col("sample_id").alias("profile"), F.col("node_id").alias("first"), "cluster_id", "is_mixed")
    # mixed samples stay alone, each of them, unless they have joined clusters of others
    alone = F.col("is_mixed") & (F.col("cluster_id") == F.col("first")) if mode != "ignore" else F.lit(False)
    rows = scratch.write(own.join(found, "profile").select("sample_id", "node_id", F.when(alone, F.col("node_id")).otherwise(F.col("cluster_id")).alias("cluster_id"), "is_mixed"))
    last = rows.groupBy("cluster_id").agg(F.max("node_id").alias("change_id"))
    return rows.join(last, "cluster_id").select("sample_id", "node_id", "cluster_id", "change_id", "is_mixed")


def cluster_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_member"))


def crosstab_mixed(found: DataFrame) -> DataFrame:
    """Members of each cluster by whether they are mixed."""
    return found.groupBy("cluster_id").agg(F.count_if("is_mixed").alias("is_mixed_true"), F.count_if(~F.col("is_mixed")).alias("is_mixed_false"))


def change_feed(found: DataFrame, after: int) -> DataFrame:
    """Rows whose cluster changed after a change_id."""
    return found.where(F.col("change_id") > after).select("sample_id", "cluster_id", "change_id", "is_mixed")


def simplify(found: DataFrame) -> DataFrame:
    """Each cluster as a star around its smallest node: the same clusters with as few edges as possible."""
    return found.where("node_id <> cluster_id").select(F.col("cluster_id").alias("u"), F.col("node_id").alias("v"))


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges of none of the given samples."""
    r = removed.select("sample_id")
    return edges.join(r, F.col("a") == F.col("sample_id"), "left_anti").join(r, F.col("b") == F.col("sample_id"), "left_anti")


def restored(edges: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """All edges of the graph again, after it was simplified or samples were taken out: they come from the edge table, once per pair."""
    return induced(edges.where((F.col("dist") <= threshold) & (F.col("a") < F.col("b"))), nodes)


def degree_z(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(sample_id, degree, degree_z)``: degree less the median of the linked samples, over their median absolute deviation, which is 1 at least."""
    return degree_scores(nodes, edges.groupBy(F.col("a").alias("sample_id")).agg(F.count("*").alias("degree")))


def degree_scores(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """As ``degree_z``, of the degrees of the linked samples."""
    rows = nodes.select("sample_id").join(degree, "sample_id", "left").select("sample_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    middle = degree.agg(F.median("degree").alias("med"))
    spread = degree.join(F.broadcast(middle)).agg(F.first("med").alias("med"), F.greatest(F.median(F.abs(F.col("degree") - F.col("med"))), F.lit(1.0)).alias("mad"))
    return rows.join(F.broadcast(spread)).select("sample_id", "degree", F.round((F.col("degree") - F.col("med")) / F.col("mad"), 9).alias("degree_z"))


def representatives(spark: SparkSession, nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """A maximal set of samples without edges among them: what a greedy pass in random order would pick.

    In each round the samples whose priority is lower than that of all their remaining neighbours are picked and these neighbours dropped.
    """
    scratch = Scratch(spark, "representatives")
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c), c)
    left = scratch.write(edges.select("a", "b").where("a <> b").distinct())
    chosen = scratch.write(nodes.select("sample_id").join(left, F.col("sample_id") == F.col("a"), "left_anti"))
    while left.limit(1).count():
        lowest = left.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low"))
        picked = scratch.write(lowest.where(rank(F.col("a")) < F.col("low")).select(F.col("a").alias("sample_id")))
        gone = scratch.write(picked.union(left.join(picked, F.col("a") == F.col("sample_id"), "left_semi").select("b")).distinct())
        remaining = left.join(gone, F.col("a") == F.col("sample_id"), "left_anti").join(gone, F.col("b") == F.col("sample_id"), "left_anti")
        survivors = left.select("a").distinct().join(gone, F.col("a") == F.col("sample_id"), "left_anti").join(remaining.select(F.col("a").alias("k")).distinct(), F.col("a") == F.col("k"), "left_anti")
        chosen = scratch.write(chosen.union(picked).union(survivors.select("a")))
        left = scratch.write(remaining)
    return chosen


def spanning_trees(found: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """``(cluster_id, a, b, dist)``: a minimum spanning tree of each cluster, ties by (dist, a, b). One task holds one cluster's edges."""
    import pandas as pd

    member = found.select("sample_id", "cluster_id")
    inner = edges.where((F.col("dist") <= threshold) & (F.col("a") < F.col("b"))).join(member, F.col("a") == F.col("sample_id")).drop("sample_id")
    inner = inner.join(member.withColumnRenamed("cluster_id", "c2"), (F.col("b") == F.col("sample_id")) & (F.col("cluster_id") == F.col("c2"))).select("cluster_id", "a", "b", "dist")

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        keep = []
        for row in pdf.sort_values(["dist", "a", "b"]).itertuples(index=False):
            x, y = find(row.a), find(row.b)
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append(row)
        return pd.DataFrame(keep, columns=pdf.columns)

    return inner.groupBy("cluster_id").applyInPandas(tree, inner.schema)


def network_json(nodes: DataFrame, edges: DataFrame, threshold: int, max_edges: int = 100_000) -> DataFrame:
    """One row ``(success, elements)``: nodes and edges for a network viewer, weight 1/(1+dist); refused above ``max_edges``."""
    e = edges.where((F.col("dist") <= threshold) & (F.col("a") < F.col("b")))
    if e.limit(max_edges + 1).count() > max_edges:
        return nodes.sparkSession.createDataFrame([(0, None)], "success int, elements string")
    n = nodes.agg(F.sort_array(F.collect_list(F.struct(F.struct(F.col("sample_id").alias("id")).alias("data")))).alias("nodes"))
    x = e.agg(F.sort_array(F.collect_list(F.struct(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), (1 / (1 + F.col("dist"))).alias("weight")).alias("data")))).alias("edges"))
    return n.join(x).select(F.lit(1).alias("success"), F.to_json(F.struct("nodes", "edges")).alias("elements"))
