"""Builds of a variation model: their rows in the store, categories, populations, matrices and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import codec
from lociflow.operators.popstat import combination_id

#: Probabilities below this are stored as 0.
LEAST_P = 1e-30


def latest(builds: DataFrame, loaded_only: bool = True) -> DataFrame:
    """One row: the largest build id, of loaded builds unless all are asked for; null without any."""
    return (builds.where("loaded") if loaded_only else builds).agg(F.max("build_id").alias("build_id"))


def of_build(rows: DataFrame, build: DataFrame) -> DataFrame:
    """Rows of the build that ``latest`` gives."""
    return rows.join(F.broadcast(build), "build_id", "left_semi")


def recent_categories(summary: DataFrame, days: int, today: str) -> DataFrame:
    """Summary rows of categories first seen at most ``days`` before a day."""
    age = F.date_diff(F.lit(today).cast("date"), "earliest_date")
    return summary.withColumn("age", age).where(F.col("age") <= days)


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; an error if there is none."""
    found = rows.where(F.col(key) == value).limit(1)
    if not found.count():
        raise KeyError(f"no row with {key} = {value}")
    return found


def feature_rows(stored: DataFrame, feature: str) -> DataFrame:
    """Stored associations of one feature."""
    return stored.where(F.col("feature") == feature)


def category_dates(coords: DataFrame, clinical: DataFrame) -> DataFrame:
    """Each sample's category with the first and last date of the category."""
    w = Window.partitionBy("pc_cat")
    rows = coords.join(clinical.select("sample_id", "sample_date"), "sample_id")
    return rows.select("sample_id", "pc_cat", "sample_date", F.min("sample_date").over(w).alias("earliest_date"), F.max("sample_date").over(w).alias("latest_date"))


def outliers(weights: DataFrame, fold: float = 5.0) -> DataFrame:
    """Rows of ``weights(pc, weight, ...)`` further from the component's median than ``fold`` median absolute deviations."""
    middle = weights.groupBy("pc").agg(F.median("weight").alias("med"))
    spread = weights.join(F.broadcast(middle), "pc").groupBy("pc").agg(F.first("med").alias("med"), F.median(F.abs(F.col("weight") - F.col("med"))).alias("mad"))
    rows = weights.join(F.broadcast(spread), "pc")
    return rows.where(F.abs(F.col("weight") - F.col("med")) > fold * F.col("mad")).drop("med", "mad")


def populations(clinical: DataFrame, columns: tuple[str, ...], categories: DataFrame | None = None) -> DataFrame:
    """``(pop_id, columns...)``: the distinct combinations of some columns by the digest that names them, joined with their categories if these are given."""
    rows = clinical if categories is None else clinical.join(categories.select("sample_id", "pc_cat"), "sample_id")
    keys = [*columns, *([] if categories is None else ["pc_cat"])]
    return rows.select(*keys).dropDuplicates().withColumn("pop_id", combination_id({c: F.col(c) for c in columns}))


def unprepared(samples: DataFrame, prepared: DataFrame) -> DataFrame:
    """Valid samples that no vector was made of yet."""
    return samples.where("invalid = 0").select("sample_id").join(prepared.select("sample_id"), "sample_id", "left_anti")


def matrix_rows(used: DataFrame, variants: DataFrame, alleles: DataFrame) -> DataFrame:
    """``(sample_id, columns)``: for each sample of the model the sorted names of the columns that are 1, so that no dense matrix is made; samples without any have an empty list."""
    own = variants.join(alleles.select("pos", "base"), ["pos", "base"], "left_semi").groupBy("sample_id").agg(F.array_sort(F.collect_list(codec.column_name(F.col("pos"), F.col("base")))).alias("columns"))
    return used.select("sample_id").join(own, "sample_id", "left").select("sample_id", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def stored_fits(fits: DataFrame, build: int, analysis: str) -> DataFrame:
    """Fits as they are stored: the build, the kind of analysis, and tiny probabilities as 0."""
    return fits.withColumns({"build_id": F.lit(build), "analysis": F.lit(analysis), "p_value": F.when(F.col("p_value") < LEAST_P, 0.0).otherwise(F.col("p_value"))})


def fit_counts(stored: DataFrame) -> DataFrame:
    """``(build_id, analysis, n_models, n_completed)``."""
    return stored.groupBy("build_id", "analysis").agg(F.count("*").alias("n_models"), F.count_if(F.col("status") == "completed").alias("n_completed"))


def with_category(stored: DataFrame, categories: DataFrame) -> DataFrame:
    """Fits with what is known of their category."""
    return stored.join(categories, "pc_cat")


def trees_input(trending: DataFrame, population: DataFrame, most: int) -> DataFrame:
    """``(sample_id, sample_date, expanding)``: the newest ``most`` samples of the population that aren't trending, and the newest ``most`` that are."""
    newest = lambda df, flag: df.orderBy(F.desc("sample_date"), "sample_id").limit(most).select("sample_id", "sample_date", F.lit(flag).alias("expanding"))
    controls = population.join(trending.select("sample_id"), "sample_id", "left_anti")
    return newest(controls, "N").union(newest(trending, "Y"))
