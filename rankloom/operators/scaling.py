"""Scalers fitted on training rows only, fold changes and cohort harmonisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rankloom.functions.random import normal, uniform
from rankloom.operators.aggregates import column_stats


def standardise(train: DataFrame, test: DataFrame | None = None, by: list[str] = ["f"],
                value: str = "x") -> DataFrame:
    """(x - mean) / population std per feature, a zero std counting as 1."""
    st = column_stats(train, by, value).select(*by, "mean", "std")
    sd = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return ((train if test is None else test).join(st, by)
            .withColumn(value, (F.col(value) - F.col("mean")) / sd).drop("mean", "std"))


def scale_labels(train: DataFrame, test: DataFrame, how: str, item: str = "i", label: str = "y") -> DataFrame:
    """Min-max, z-score or max-abs scaling of the test labels with training statistics per
    item; a zero range, std or maximum counts as 1."""
    st = column_stats(train, [item], label)
    y = F.col(label)
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    forms = {
        "minmax": (y - F.col("lo")) / one(F.col("hi") - F.col("lo")),
        "zscore": (y - F.col("mean")) / one(F.col("std")),
        "maxabs": y / one(F.col("absmax")),
    }
    if how not in forms:
        raise ValueError(f"unknown scaling {how!r}; use one of {sorted(forms)}")
    return (test.join(st, item).withColumn(label, forms[how])
            .drop("mean", "std", "lo", "hi", "absmax"))


def fold_change(df: DataFrame, ref: DataFrame | None = None, feature: str = "f", value: str = "x") -> DataFrame:
    """Difference to the feature mean, of this table or of a reference cohort (then only
    the features both have)."""
    mean = (df if ref is None else ref).groupBy(feature).agg(F.avg(value).alias("__m"))
    return df.join(mean, feature).withColumn(value, F.col(value) - F.col("__m")).drop("__m")


def concat_features(parts: dict[str, DataFrame], by: str = "g", feature: str = "f", value: str = "x") -> DataFrame:
    """Prefixed features of several modalities for the groups all of them have."""
    common = reduce(lambda a, b: a.intersect(b), [d.select(by) for d in parts.values()])
    long = reduce(lambda a, b: a.unionByName(b), [
        d.select(by, F.concat(F.lit(f"{n}:"), F.col(feature).cast("string")).alias(feature),
                 F.col(value).cast("double").alias(value)) for n, d in parts.items()])
    return long.join(common, by, "left_semi")


def harmonise(a: DataFrame, b: DataFrame, by: str = "g", feature: str = "f", value: str = "x") -> DataFrame:
    """Per-feature location and scale of each cohort replaced with the pooled ones, on the
    features both cohorts have; duplicate cells are averaged first."""
    rows = (a.select(F.lit("a").alias("batch"), by, feature, value)
            .unionByName(b.select(F.lit("b").alias("batch"), by, feature, value))
            .groupBy("batch", by, feature).agg(F.avg(value).alias(value)))
    v = F.col(value)
    st = rows.groupBy(feature, "batch").agg(
        F.avg(v).alias("m"), F.stddev_pop(v).alias("sd"), F.count(v).alias("n"))
    # Pooled mean and within-batch variance come from the small per-batch rows.
    pooled = st.groupBy(feature).agg(
        F.count("*").alias("batches"),
        (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("pm"),
        F.sqrt(F.sum(F.col("sd") * F.col("sd") * F.col("n")) / F.sum("n")).alias("psd")
    ).where("batches = 2").drop("batches")
    scale = (st.join(pooled, feature)
             .select(feature, "batch", "m", "pm", "psd",
                     F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd")))
    return (rows.join(scale, [feature, "batch"])
            .select("batch", by, feature,
                    ((v - F.col("m")) / F.col("sd") * F.col("psd") + F.col("pm")).alias(value)))


def augment(df: DataFrame, stats: DataFrame, sigma: float, mu: float = 0.0, seed=0, prob: float = 0.5,
            by: str = "g", feature: str = "f", value: str = "x") -> DataFrame:
    """One coin per group: heads adds N(mu, sigma) noise to each of its values; then all
    values are standardised with the clean training mean and std."""
    coin = uniform(f"{seed}:coin", by) < prob
    noisy = F.col(value) + F.when(coin, F.lit(mu) + F.lit(sigma) * normal(seed, by, feature)).otherwise(0.0)
    sd = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return (df.withColumn(value, noisy).join(stats.select(feature, "mean", "std"), feature)
            .withColumn(value, (F.col(value) - F.col("mean")) / sd).drop("mean", "std"))
