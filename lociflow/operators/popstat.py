"""Population statistics: summaries of categories, daily counts, associations and trends."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(coords: DataFrame, clinical: DataFrame, by: tuple[str, ...] = ("country",)) -> DataFrame:
    """Dates, coordinates and numbers of samples of each category of a component, by further columns."""
    rows = coords.join(clinical, "sample_id")
    return rows.groupBy("pc", "pc_cat", *by).agg(
        F.min("sample_date").alias("earliest_date"),
        F.max("sample_date").alias("latest_date"),
        F.count_distinct("sample_date").alias("n_days"),
        F.round(F.min("coord"), 6).alias("min_coord"),
        F.round(F.max("coord"), 6).alias("max_coord"),
        F.round(F.avg("coord"), 6).alias("mean_coord"),
        F.count_distinct("sample_id").alias("n_samples"),
    )


def contingency(coords: DataFrame, features: DataFrame) -> DataFrame:
    """``(pc_cat, feature, a, b, c, d)``: samples in the category with and without the feature, and outside it with and without.

    All marginals are counts per key; categories and features meet only where some sample has both, other pairs have a = 0.
    """
    rows = coords.select("sample_id", "pc", "pc_cat")
    joint = rows.join(features.select("sample_id", "feature").distinct(), "sample_id").groupBy("pc", "pc_cat", "feature").agg(F.count_distinct("sample_id").alias("a"))
    in_cat = rows.groupBy("pc", "pc_cat").agg(F.count_distinct("sample_id").alias("n_cat"))
    in_pc = rows.groupBy("pc").agg(F.count_distinct("sample_id").alias("n_all"))
    with_feature = joint.groupBy("pc", "feature").agg(F.sum("a").alias("n_feature"))
    grid = in_cat.join(in_pc, "pc").join(with_feature, "pc").join(joint, ["pc", "pc_cat", "feature"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
    return grid.select("pc", "pc_cat", "feature", "a", (F.col("n_cat") - F.col("a")).alias("b"), (F.col("n_feature") - F.col("a")).alias("c"), (F.col("n_all") - F.col("n_cat") - F.col("n_feature") + F.col("a")).alias("d"))


def odds_ratio(tables: DataFrame) -> DataFrame:
    """Log odds ratio with half a case added to every cell, its interval, and the rates of the category as a test for the feature."""
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    log_or, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    rate = lambda x, y: F.round(F.col(x) / (F.col(x) + F.col(y)), 9)
    out = tables.withColumns({"log_or": F.round(log_or, 9), "log_or_low": F.round(log_or - 1.96 * se, 9), "log_or_high": F.round(log_or + 1.96 * se, 9), "z": F.round(log_or / se, 9)})
    return out.withColumns({"sensitivity": rate("a", "c"), "specificity": rate("d", "b"), "ppv": rate("a", "b"), "npv": rate("d", "c")})


def p_normal(tables: DataFrame) -> DataFrame:
    """Two-sided normal probability of ``z``."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return tables.withColumn("p_value", tail("z"))


def g_test(tables: DataFrame) -> DataFrame:
    """G statistic of a 2x2 table, and the odds ratio held in [1e-6, 1e6]."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    part = lambda o, r, s: F.when(o > 0, o * F.log(o * n / (r * s))).otherwise(0.0)
    g = 2 * (part(a, a + b, a + c) + part(b, a + b, b + d) + part(c, c + d, a + c) + part(d, c + d, b + d))
    ratio = F.when(b * c > 0, a * d / F.nullif(b * c, F.lit(0.0))).otherwise(F.lit(1e6))
    return tables.withColumns({"g": F.round(g, 6), "odds": F.round(F.greatest(F.least(ratio, F.lit(1e6)), F.lit(1e-6)), 6)})


def daily_counts(coords: DataFrame, clinical: DataFrame) -> DataFrame:
    """``(pc, pc_cat, sample_date, n, n_total)``: samples a day in each category, and in all of the component."""
    n = coords.join(clinical, "sample_id").groupBy("pc", "pc_cat", "sample_date").agg(F.count_distinct("sample_id").alias("n"))
    return n.withColumn("n_total", F.sum("n").over(Window.partitionBy("pc", "sample_date")))


def dense_calendar(counts: DataFrame) -> DataFrame:
    """Daily counts with a row for every day from the first to the last, zero where there was none."""
    days = counts.agg(F.min("sample_date").alias("lo"), F.max("sample_date").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("sample_date"))
    cats = counts.select("pc", "pc_cat").distinct()
    totals = counts.select("pc", "sample_date", "n_total").distinct()
    grid = cats.join(F.broadcast(days))  # as many rows as the result has
    rows = grid.join(totals, ["pc", "sample_date"], "left").join(counts.drop("n_total"), ["pc", "pc_cat", "sample_date"], "left")
    return rows.select("pc", "pc_cat", "sample_date", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_total", F.lit(0)).alias("n_total"))


def modelling_table(calendar: DataFrame) -> DataFrame:
    """Days with samples: days before the last one as t (0 on it, negative before) and the weekday."""
    last = calendar.where("n_total > 0").agg(F.max("sample_date").alias("last"))
    rows = calendar.where("n_total > 0").join(F.broadcast(last))
    return rows.select("pc", "pc_cat", "sample_date", "n", "n_total", F.date_diff("sample_date", "last").alias("t"), F.concat(F.lit("dow"), F.weekday("sample_date").cast("string")).alias("dow"))


def drop_first(coords: DataFrame, clinical: DataFrame, k: int) -> DataFrame:
    """All but the first k samples of each category."""
    rank = F.row_number().over(Window.partitionBy("pc_cat").orderBy("sample_date", "sample_id"))
    return coords.join(clinical, "sample_id").withColumn("rank", rank).where(F.col("rank") > k).select("pc_cat", "sample_id", "sample_date", "rank")


def false_discovery(fits: DataFrame, p: str = "p_value", m: int | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted probabilities; ``m`` tests, by default the rows.

    Ties share a value. Groups of equal probability are ranked by a running count, one row per distinct probability.
    """
    levels = fits.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("level")).agg(F.count("*").alias("n"))
    up = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.lit(m).cast("double") if m is not None else F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = levels.withColumns({"rank": F.sum("n").over(up), "m": total}).withColumn("raw", F.col("level") * F.col("m") / F.col("rank"))
    adjusted = ranked.withColumn("fdr", F.least(F.min("raw").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(1.0)))
    return fits.join(adjusted.select(F.col("level").alias(p), F.round("fdr", 9).alias("fdr")), p, "left")


def poisson_trends(table: DataFrame, least_days: int = 3, rounds: int = 50) -> DataFrame:
    """``(pc_cat, n_days, slope, slope_se, p_value, status)``: n ~ t with the logarithm of n_total as offset, one model per category.

    Iteratively reweighted least squares on sums over days, for which one task holds one category's days.
    """
    return _trend(table, least_days, rounds, None)


def negative_binomial_trends(table: DataFrame, least_days: int = 3, rounds: int = 100, dispersion: float = 1.0) -> DataFrame:
    """As ``poisson_trends`` with a negative binomial law of fixed dispersion; fits that don't converge are marked failed."""
    return _trend(table, least_days, rounds, dispersion)


def _trend(table: DataFrame, least_days: int, rounds: int, dispersion: float | None) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), pdf["t"].to_numpy(float)])
        y, offset = pdf["n"].to_numpy(float), np.log(pdf["n_total"].to_numpy(float))
        cat, status, beta, cov = pdf["pc_cat"].iloc[0], "failed", np.array([np.nan, np.nan]), np.full((2, 2), np.nan)
        if len(pdf) >= least_days and y.sum() > 0 and len(set(pdf["t"])) > 1:
            beta = np.array([math.log(y.sum() / np.exp(offset).sum()), 0.0])
            for _ in range(rounds):
                mu = np.exp(np.clip(offset + x @ beta, -30, 30))
                w = mu / (1 + dispersion * mu) if dispersion else mu
                z = x @ beta + (y - mu) / mu
                h = x.T @ (w[:, None] * x)
                try:
                    new = np.linalg.solve(h, x.T @ (w * z))
                except np.linalg.LinAlgError:
                    break
                done = np.abs(new - beta).max() < 1e-9
                beta = new
                if done:
                    cov, status = np.linalg.inv(h), "completed"
                    break
        se = math.sqrt(cov[1, 1]) if status == "completed" and cov[1, 1] > 0 else float("nan")
        p = math.erfc(abs(beta[1] / se) / math.sqrt(2)) if se == se else None
        return pd.DataFrame([{"pc_cat": cat, "n_days": len(pdf), "slope": beta[1], "slope_se": se, "p_value": None if p is None else (0.0 if p < 1e-30 else p), "status": status}])

    return table.groupBy("pc_cat").applyInPandas(fit, "pc_cat string, n_days long, slope double, slope_se double, p_value double, status string")


def significant_trends(fits: DataFrame, cutoff: float = 0.01, adjusted: bool = True) -> DataFrame:
    """Increasing trends that pass the cutoff; adjustment is over the increasing ones."""
    rising = fits.where("slope > 0 and p_value is not null")
    return false_discovery(rising).where(F.col("fdr" if adjusted else "p_value") <= cutoff)


def members(coords: DataFrame, clinical: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` samples of each category, ties by id."""
    newest = F.row_number().over(Window.partitionBy("pc_cat").orderBy(F.desc("sample_date"), "sample_id"))
    return coords.join(clinical, "sample_id").withColumn("rank", newest).where(F.col("rank") <= most).select("pc_cat", "sample_id", "sample_date", "rank")


def trending_pivot(coords: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """One row per sample with a column for each of the categories: 1 if it is in it."""
    return coords.groupBy("sample_id").agg(*[F.max((F.col("pc_cat") == c).cast("int")).alias(f"in_{c}") for c in categories])


def combination_id(cols: dict[str, Column]) -> Column:
    """Digest over ``|name:value`` of some columns; nulls are written as empty."""
    return F.md5(F.concat(*[x for name, c in cols.items() for x in (F.lit(f"|{name}:"), F.coalesce(c.cast("string"), F.lit("")))]))


def lineage_prefix(lineage: Column, prefix: str) -> Column:
    """Whether a lineage is one or descends from it."""
    return (lineage == prefix) | lineage.startswith(prefix + ".")


def exclusive_features(tables: DataFrame) -> DataFrame:
    """Features that stand in one category of a component only."""
    return tables.groupBy("pc", "feature").agg(F.count_if(F.col("a") > 0).alias("n_cats"), F.max_by("pc_cat", "a").alias("pc_cat"), F.max("a").alias("n")).where("n_cats = 1").select("pc", "feature", "pc_cat", "n")
