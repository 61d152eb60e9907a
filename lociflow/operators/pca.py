"""From variants to principal components and categories along them."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.scratch import Scratch


def allele_counts(variants: DataFrame) -> DataFrame:
    """``(pos, base, n)``."""
    return variants.groupBy("pos", "base").agg(F.count("*").alias("n"))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of two disjoint sets of samples as one."""
    return old.unionByName(new).groupBy("pos", "base").agg(F.sum("n").alias("n"))


def missingness(unknowns: DataFrame) -> DataFrame:
    """``(pos, n_missing)``."""
    return unknowns.groupBy("pos").agg(F.count_distinct("sample_id").alias("n_missing"))


def missingness_cutoff(counts: DataFrame, missing: DataFrame, fold: float = 10.0) -> DataFrame:
    """One row: ``fold`` times the median number of missing samples over the positions that vary."""
    at = counts.select("pos").distinct().join(missing, "pos", "left").select(F.coalesce("n_missing", F.lit(0)).alias("n_missing"))
    return at.agg(F.round(fold * F.median("n_missing"), 6).alias("cutoff"))


def selected_alleles(counts: DataFrame, missing: DataFrame, n_samples: int, least_share: float, cutoff: float) -> DataFrame:
    """Alleles frequent enough, at positions with fewer missing samples than the cutoff."""
    bad = missing.where(F.col("n_missing") >= cutoff).select("pos")
    return counts.where(F.col("n") >= n_samples * least_share).join(bad, "pos", "left_anti").select("pos", "base", "n")


def sample_qc(ids: DataFrame, unknowns: DataFrame, alleles: DataFrame, most_share: float = 0.05) -> DataFrame:
    """``(sample_id, n_missing, used)``: samples with too many unknown positions among the model's are left out."""
    sites = alleles.select("pos").distinct()
    total = sites.agg(F.count("*").alias("total"))
    n = unknowns.join(sites, "pos").groupBy("sample_id").agg(F.count_distinct("pos").alias("n_missing"))
    rows = ids.select("sample_id").join(n, "sample_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0))).join(F.broadcast(total))
    return rows.select("sample_id", "n_missing", (F.col("n_missing") <= most_share * F.col("total")).alias("used"))


def components(ids: DataFrame, variants: DataFrame, alleles: DataFrame, n_components: int) -> tuple[DataFrame, list[float]]:
    """``(sample_id, pc, coord)`` of the centred 0/1 matrix of samples and alleles, and the share of variance of each component.

    Rows are vectors of the selected alleles, of which there are as many as the model has dimensions.
    """
    order = [(r["pos"], r["base"]) for r in alleles.select("pos", "base").distinct().orderBy("pos", "base").collect()]
    keys = F.array(*[F.lit(f"{p}:{b}") for p, b in order])
    own = variants.groupBy("sample_id").agg(F.collect_set(F.concat_ws(":", "pos", "base")).alias("own"))
    rows = ids.select("sample_id").join(own, "sample_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    matrix = rows.select("sample_id", array_to_vector(F.transform(keys, lambda k: F.array_contains("own", k).cast("double"))).alias("raw"))
    matrix = Scratch(ids.sparkSession, "matrix").write(matrix)  # read by each pass of the model
    scaled = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(matrix).transform(matrix)
    model = PCA(k=min(n_components, len(order)), inputCol="x", outputCol="y").fit(scaled)
    coords = model.transform(scaled).select("sample_id", F.posexplode(vector_to_array("y")).alias("pc", "coord"))
    return coords, list(model.explainedVariance)


def bin_centres(coords: DataFrame, per_unit: int = 8) -> DataFrame:
    """Means of the coordinates in bins of width 1/per_unit, truncated towards zero: where categories start."""
    cell = F.when(F.col("coord") >= 0, F.floor(F.col("coord") * per_unit)).otherwise(F.ceil(F.col("coord") * per_unit))
    return coords.groupBy("pc", cell.cast("long").alias("bin")).agg(F.round(F.avg("coord"), 9).alias("centre"), F.count("*").alias("n"))


def categories(spark: SparkSession, coords: DataFrame, per_unit: int = 8, rounds: int = 20) -> DataFrame:
    """``(sample_id, pc, coord, cat, pc_cat)``: k-means along each component from the bin centres, by Lloyd's iterations.

    On a line a coordinate belongs to the centre between whose midpoints it lies; the centres of a component, as many as its bins, are an array that each row searches.
    """
    scratch = Scratch(spark, "categories")
    c = scratch.write(coords.select("sample_id", "pc", "coord"))
    centres = scratch.write(bin_centres(c, per_unit).groupBy("pc").agg(F.array_sort(F.collect_set("centre")).alias("centres")))

    def nearest(table: DataFrame) -> DataFrame:
        cuts = F.transform(F.sequence(F.lit(1), F.size("centres") - 1), lambda i: (F.get("centres", i - 1) + F.get("centres", i)) / 2)
        cuts = F.when(F.size("centres") > 1, cuts).otherwise(F.array().cast("array<double>"))
        return c.join(table.withColumn("cuts", cuts), "pc").withColumn("cat", F.size(F.filter("cuts", lambda m: m < F.col("coord"))))

    for _ in range(rounds):
        moved = nearest(centres).groupBy("pc", "cat").agg(F.round(F.avg("coord"), 9).alias("centre")).groupBy("pc").agg(F.array_sort(F.collect_set("centre")).alias("centres"))
        new = scratch.write(moved)
        same = new.exceptAll(centres).limit(1).count() == 0
        centres = new
        if same:
            break
    return nearest(centres).select("sample_id", "pc", "coord", "cat", F.concat_ws("_", "pc", "cat").alias("pc_cat"))
