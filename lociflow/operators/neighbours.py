"""Look-ups in the edge table and in the samples' quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validity(ids: DataFrame, samples: DataFrame) -> DataFrame:
    """``(sample_id, validity)`` of asked ids: -1 unknown, 0 valid, 1 invalid."""
    return ids.join(samples.select("sample_id", "invalid"), "sample_id", "left").select("sample_id", F.coalesce("invalid", F.lit(-1)).alias("validity"))


def passes(quality: Column, cutoff: float) -> Column:
    """Null without a quality, else whether it reaches the cutoff."""
    return quality >= F.lit(cutoff)


def quality_over(samples: DataFrame, cutoff: float) -> DataFrame:
    return samples.where(F.col("prop_actg") >= cutoff).select("sample_id", "prop_actg")


def prefix_search(samples: DataFrame, prefix: str, most: int = 30, or_none: bool = False) -> DataFrame:
    """The first ``most`` ids with a prefix, in order; with ``or_none`` no id at all where there are as many or more."""
    if or_none and samples.where(F.col("sample_id").startswith(prefix)).select("sample_id").distinct().limit(most).count() >= most:
        return samples.select("sample_id").limit(0)
    return samples.where(F.col("sample_id").startswith(prefix)).select("sample_id").distinct().orderBy("sample_id").limit(most)


def added_after(samples: DataFrame, sample_id: str, key: str = "k") -> DataFrame:
    """Ids inserted after a sample; none if it is unknown."""
    at = samples.where(F.col("sample_id") == sample_id).agg(F.max(key).alias("at"))
    return samples.join(F.broadcast(at), F.col(key) > F.col("at")).select("sample_id")


def examined_after(samples: DataFrame, when: str) -> DataFrame:
    return samples.where(F.col("examined") > F.lit(when).cast("date")).select("sample_id", "examined")


def examined_after_sample(samples: DataFrame, sample_id: str) -> DataFrame:
    """Samples examined after another one; none if it is unknown."""
    at = samples.where(F.col("sample_id") == sample_id).agg(F.max("examined").alias("at"))
    return samples.join(F.broadcast(at), F.col("examined") > F.col("at")).select("sample_id")


def ordered(edges: DataFrame, sample_id: str, threshold: int) -> DataFrame:
    """``(rank, b, dist)``: a sample's neighbours, the nearest first."""
    w = Window.partitionBy("a").orderBy("dist", "b")
    return neighbours(edges, threshold, sample_id).withColumn("rank", F.row_number().over(w)).select("rank", "b", "dist")


def neighbours(edges: DataFrame, threshold: int, sample_id: str | None = None, form: int = 1) -> DataFrame:
    """Neighbours within a distance: form 1 ``(a, b, dist)``, form 3 ids only, form 4 as a struct; 2 was never made."""
    if form not in (1, 3, 4):
        raise NotImplementedError(f"result form {form}")
    found = edges.where(F.col("dist") <= threshold)
    if sample_id is not None:
        found = found.where(F.col("a") == sample_id)
    if form == 3:
        return found.select("a", "b")
    if form == 4:
        return found.select("a", F.struct(F.col("b").alias("guid"), F.col("dist").alias("snv")).alias("neighbour"))
    return found.select("a", "b", "dist")


def neighbours_of_quality(edges: DataFrame, samples: DataFrame, threshold: int, cutoff: float) -> DataFrame:
    """Neighbours whose quality, and that of the sample asked for, reaches a cutoff; a cutoff of 0 asks for nothing."""
    found = neighbours(edges, threshold)
    if not cutoff:
        return found
    good = samples.where(F.col("prop_actg") >= cutoff).select("sample_id")
    return found.join(good, F.col("a") == F.col("sample_id"), "left_semi").join(good, F.col("b") == F.col("sample_id"), "left_semi")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in a set."""
    s = ids.select("sample_id")
    return edges.join(s, F.col("a") == F.col("sample_id"), "left_semi").join(s, F.col("b") == F.col("sample_id"), "left_semi")


def top_mixed(edges: DataFrame, mixed_bases: DataFrame, threshold: int, most: int) -> DataFrame:
    """For each sample its ``most`` neighbours with the most mixed bases, ties by id."""
    rows = neighbours(edges, threshold).join(mixed_bases.select(F.col("sample_id").alias("b"), "n_mixed"), "b", "left").withColumn("n_mixed", F.coalesce("n_mixed", F.lit(0)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n_mixed"), "b"))).where(F.col("rank") <= most).select("a", "b", "n_mixed", "rank")


def top_mixed_of_profiles(links: DataFrame, members: DataFrame, mixed_bases: DataFrame, most: int) -> DataFrame:
    """As ``top_mixed`` of all edges, from the links of profiles: a sample's first neighbours are among the first samples of the profiles next to its own, of each one more than asked for, as the sample itself may be one of them."""
    rows = members.join(mixed_bases.select("sample_id", "n_mixed"), "sample_id", "left").withColumn("n_mixed", F.coalesce("n_mixed", F.lit(0)))
    first = lambda w: F.row_number().over(w.orderBy(F.desc("n_mixed"), "b")) <= most + 1
    some = rows.select(F.col("profile").alias("to"), F.col("sample_id").alias("b"), "n_mixed").withColumn("first", first(Window.partitionBy("to"))).where("first").drop("first")
    near = links.select("a", "b").union(links.select("b", "a")).toDF("profile", "to").union(members.select("profile", "profile").distinct())
    best = near.join(some, "to").withColumn("first", first(Window.partitionBy("profile"))).where("first").select("profile", "b", "n_mixed")
    pairs = members.select(F.col("sample_id").alias("a"), "profile").join(best, "profile").where("a <> b")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n_mixed"), "b"))).where(F.col("rank") <= most).select("a", "b", "n_mixed", "rank")


def top_singletons(edges: DataFrame, samples: DataFrame, most: int, fraction: float | None = None, seed: int = 1) -> DataFrame:
    """Samples by how few neighbours they have, the fewest first; on a sample of the edges where a fraction is given."""
    e = edges.sample(fraction, seed) if fraction else edges
    return fewest(e.groupBy(F.col("a").alias("sample_id")).agg(F.count("*").alias("degree")), samples, most)


def fewest(degree: DataFrame, samples: DataFrame, most: int) -> DataFrame:
    """As ``top_singletons``, of the degrees of the linked samples."""
    rows = samples.where("invalid = 0").select("sample_id").join(degree, "sample_id", "left").select("sample_id", F.coalesce("degree", F.lit(0)).alias("n"))
    return rows.orderBy("n", "sample_id").limit(most)
