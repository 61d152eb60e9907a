"""Unknown bases at the sites of an alignment, and the check of samples for mixtures by alignment with their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators import msa


def site_unknowns(sites: DataFrame, ids: DataFrame, unknowns: DataFrame, kind: str = "N_or_M") -> DataFrame:
    """``(cluster_id, n_samples, median_unknown, mean_unknown, sum_unknown)``: unknown bases at the sites ``(cluster_id, pos)`` of each cluster over all of ``ids``, samples without any included.

    Only samples with an unknown base at a site are joined; how many of the others there are decides where the median lies.
    """
    u = unknowns if kind == "N_or_M" else unknowns.where(F.col("kind") == kind)
    per = sites.join(u.select("sample_id", "pos").distinct().join(ids.select("sample_id"), "sample_id", "left_semi"), "pos").groupBy("cluster_id", "sample_id").agg(F.count("*").alias("n"))
    levels = per.groupBy("cluster_id", "n").agg(F.count("*").alias("m"))
    total = ids.agg(F.count("*").alias("n_samples"))
    with_any = levels.groupBy("cluster_id").agg(F.sum("m").alias("any"))
    none = sites.select("cluster_id").distinct().join(with_any, "cluster_id", "left").join(F.broadcast(total))
    levels = levels.union(none.select("cluster_id", F.lit(0).cast("long"), F.col("n_samples") - F.coalesce("any", F.lit(0)))).where("m > 0")
    upto = F.sum("m").over(Window.partitionBy("cluster_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    levels = levels.withColumn("upto", upto).join(F.broadcast(total))
    low, high = F.floor((F.col("n_samples") + 1) / 2), F.floor((F.col("n_samples") + 2) / 2)
    out = levels.groupBy("cluster_id").agg(
        F.first("n_samples").alias("n_samples"), F.min(F.when(F.col("upto") >= low, F.col("n"))).alias("lo"), F.min(F.when(F.col("upto") >= high, F.col("n"))).alias("hi"), F.sum(F.col("n") * F.col("m")).alias("sum_unknown")
    )
    return out.select("cluster_id", "n_samples", ((F.col("lo") + F.col("hi")) / 2).alias("median_unknown"), F.round(F.col("sum_unknown") / F.col("n_samples"), 9).alias("mean_unknown"), "sum_unknown")


def pair_counts(edges: DataFrame, unknowns: DataFrame, cutoff: int) -> DataFrame:
    """``(a, b, dist, n1, n2, nboth)``: positions without a base of both samples and in their union, null beyond the cutoff."""
    n = unknowns.where("kind = 'N'").groupBy("sample_id").agg(F.collect_set("pos").alias("p"))
    none = F.array().cast("array<int>")
    near = edges.join(n.select(F.col("sample_id").alias("a"), F.col("p").alias("pa")), "a", "left").join(n.select(F.col("sample_id").alias("b"), F.col("p").alias("pb")), "b", "left")
    pa, pb = F.coalesce("pa", none), F.coalesce("pb", none)
    inside = F.col("dist") <= cutoff
    return near.select("a", "b", "dist", *[F.when(inside, F.size(x).cast("long")).alias(c) for c, x in (("n1", pa), ("n2", pb), ("nboth", F.array_union(pa, pb)))])


def focal_groups(ids: DataFrame, edges: DataFrame, mixed_bases: DataFrame, threshold: int, most: int) -> DataFrame:
    """``(cluster_id, sample_id)``: each sample with at least two neighbours, by whose id the group is named, and its neighbours, at most ``most`` of them: those with the most mixed bases, ties by id."""
    near = edges.where(F.col("dist") <= threshold).join(mixed_bases.select(F.col("sample_id").alias("b"), "n_mixed"), "b", "left")
    w = Window.partitionBy("a")
    near = near.withColumns({"rank": F.row_number().over(w.orderBy(F.coalesce("n_mixed", F.lit(0)).desc(), "b")), "n": F.count("*").over(w)}).where((F.col("rank") <= most) & (F.col("n") >= 2))
    near = near.join(ids.select(F.col("sample_id").alias("a")), "a", "left_semi")
    return near.select(F.col("a").alias("cluster_id"), F.col("b").alias("sample_id")).union(near.select("a", "a").distinct())


def check(ids: DataFrame, edges: DataFrame, variants: DataFrame, unknowns: DataFrame, reference: str, included: int, threshold: int, most: int, p1: float, criterion: str = "p_value1", cutoff: float = 0.05, least_bases: int = 0, kind: str = "M") -> DataFrame:
    """``(sample_id, is_mixed, enough_bases_mixed, observed, width, p_value)`` of every sample: aligned with its neighbours, does it hold more uncertain bases than chance explains?

    A sample is mixed if the test's probability is below the cutoff and more than ``least_bases`` uncertain bases stand in the alignment; null, not assessed, with fewer than two neighbours. All samples are
    aligned at once, each in a group of ``most`` + 1 members at most.
    """
    mixed_bases = unknowns.where("kind = 'M'").groupBy("sample_id").agg(F.count("*").alias("n_mixed"))
    groups = focal_groups(ids, edges, mixed_bases, threshold, most)
    sites = msa.variant_positions(groups, variants, len(reference), reference, unknowns)
    aligned = msa.aligned(groups, sites, variants, unknowns, reference).where("cluster_id = sample_id")
    tests = msa.mixture_tests(aligned, msa.unknown_counts(ids, unknowns), sites, included, len(reference), p1, kind=kind)
    tests = tests.select("sample_id", "observed", "width", F.col(criterion).alias("p_value"))
    rows = ids.select("sample_id").join(tests, "sample_id", "left")
    enough = F.col("observed") > least_bases
    mixed = F.when(F.col("observed").isNotNull(), F.coalesce((F.col("p_value") < cutoff) & enough, F.lit(False)))
    return rows.select("sample_id", mixed.alias("is_mixed"), F.when(F.col("p_value").isNotNull(), enough).alias("enough_bases_mixed"), "observed", "width", "p_value")


def alignment_order(tests: DataFrame, aligned: DataFrame) -> DataFrame:
    """``(cluster_id, sample_id, y_order)``: rows from the most to the least likely chance, ties by the numbers of A, C, G and T, all falling, then by id."""
    n = {b: F.length("aligned_seq") - F.length(F.replace("aligned_seq", F.lit(b))) for b in "ACGT"}
    rows = aligned.select("cluster_id", "sample_id", *[c.alias(b) for b, c in n.items()]).join(tests.select("cluster_id", "sample_id", "p_value3"), ["cluster_id", "sample_id"])
    w = Window.partitionBy("cluster_id").orderBy(F.col("p_value3").desc_nulls_last(), *[F.desc(b) for b in "ACGT"], "sample_id")
    return rows.select("cluster_id", "sample_id", (F.row_number().over(w) - 1).alias("y_order"))


def position_ranks(sites: DataFrame) -> DataFrame:
    """``(cluster_id, pos, rank, rank_prop, pos_prop)``: each site's place among its cluster's, and along the genome up to the last one."""
    w = Window.partitionBy("cluster_id")
    rows = sites.withColumns({"rank": F.row_number().over(w.orderBy("pos")) - 1, "width": F.count("*").over(w), "last": F.max("pos").over(w)})
    return rows.select("cluster_id", "pos", "rank", F.round(F.col("rank") / F.col("width"), 9).alias("rank_prop"), F.round(F.try_divide("pos", "last"), 9).alias("pos_prop"))


def letter_counts(aligned: DataFrame, column: str = "aligned_mseq") -> DataFrame:
    """``(cluster_id, sample_id, letter, n)``: composition of every aligned sequence, counted in its row."""
    rows = aligned.select("cluster_id", "sample_id", F.col(column).alias("s"), F.explode(F.array_distinct(F.split(column, ""))).alias("letter")).where("letter <> ''")
    return rows.select("cluster_id", "sample_id", "letter", (F.length("s") - F.length(F.replace("s", F.col("letter"), F.lit("")))).cast("long").alias("n"))


def alignment(ids: DataFrame, stored: DataFrame, variants: DataFrame, unknowns: DataFrame, reference: str, mask: tuple[int, ...], p1: float | None = None, strict: bool = False) -> DataFrame:
    """The alignment of a set of stored samples as one cluster, with its tests: ids that aren't stored are left out, or are an error if ``strict``.

    Without ``p1`` the share of unknown bases expected at large is the median of the stored samples' over the included positions.
    """
    asked = ids.select("sample_id").distinct()
    if strict and asked.join(stored, "sample_id", "left_anti").limit(1).count():
        raise KeyError("some of the samples are not stored")
    included = len(reference) - len(set(mask))
    members = asked.join(stored.select("sample_id"), "sample_id", "left_semi").withColumn("cluster_id", F.lit("all"))
    counts = msa.unknown_counts(stored, unknowns)
    if p1 is None:
        p1 = (msa.expected_unknown(counts).first()["median_unknown"] or 0.0) / included
    sites = msa.variant_positions(members, variants, len(reference), reference, unknowns)
    aligned = msa.aligned(members, sites, variants, unknowns, reference)
    tests = msa.mixture_tests(aligned, counts, sites, included, len(reference), float(p1), at_sites=site_unknowns(sites, stored, unknowns))
    return aligned.join(tests, ["cluster_id", "sample_id"]).drop("cluster_id")
