"""Null-skipping aggregates; every one combines on the map side before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.operators.ordering import dense_index, exact_median, first_per_key
from rankloom.operators.filters import fill_labels
from rankloom.runtime import join_groups


def marginal_means(df: DataFrame, by: str = "g", item: str = "i", value: str = "y") -> DataFrame:
    """Means per group, per item and overall in one grouping-sets pass."""
    sets = df.groupingSets([[F.col(by)], [F.col(item)], []], F.col(by), F.col(item))
    return sets.agg(F.avg(value).alias("mean"))


STATS = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def nan_stat(df: DataFrame, col: str, stat, by: list[str] = [], out: str | None = None) -> DataFrame:
    """A named statistic, or any Column -> Column callable, over the non-missing values."""
    fn = STATS[stat] if isinstance(stat, str) else stat
    name = out or (stat if isinstance(stat, str) else "stat")
    return df.where(F.col(col).isNotNull()).groupBy(*by).agg(fn(F.col(col)).alias(name))


def collapse_mean(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def weighted_mean(df: DataFrame, v: str, w: str, by: list[str], out: str = "wmean") -> DataFrame:
    """Rows with both sides present; NULL when there are none or the weights add up to 0."""
    both = F.col(v).isNotNull() & F.col(w).isNotNull()
    return df.groupBy(*by).agg(
        (F.sum(F.when(both, F.col(v) * F.col(w)))
         / F.nullif(F.sum(F.when(both, F.col(w))), F.lit(0.0))).alias(out))


def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def fill_rates(df: DataFrame) -> DataFrame:
    """Filled cells per column: TRUE values for booleans, non-missing values otherwise."""
    def filled(c: str, t: str) -> Column:
        return F.count_if(F.col(c)) if t == "boolean" else F.count(F.col(c))
    one = df.agg(F.count("*").alias("__rows"), *[filled(c, t).alias(c) for c, t in df.dtypes])
    return one.unpivot("__rows", [c for c, _ in df.dtypes], "column", "filled").select(
        "column", "filled", F.col("__rows").alias("rows"))


def count_where(df: DataFrame, conditions: dict[str, Column], by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def median_impute(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Missing values replaced with the exact median of their key."""
    med = exact_median(df, by, col, "__med")
    return join_groups(df, med, by, "left").withColumn(col, F.coalesce(col, "__med")).drop("__med")


def pivot_latest(df: DataFrame, by: str, item: str, value: str, order: Column) -> DataFrame:
    """Long cells where the last write of each (by, item) wins."""
    return df.groupBy(by, item).agg(F.max_by(value, order).alias(value))


def pivot_matrix(df: DataFrame, by: str, item: str, value: str, order: Column,
                 default: float = -1.0) -> DataFrame:
    """Every (by, item) cell; never-written cells hold the default."""
    return fill_labels(pivot_latest(df, by, item, value, order), default, by, item, value)


def last_attrs(df: DataFrame, by: str, attrs: list[str], order: Column) -> DataFrame:
    return df.groupBy(by).agg(*[F.max_by(a, order).alias(a) for a in attrs])


def pivot_measures(df: DataFrame, keys: list[str], measures: dict[str, Column], order: Column) -> DataFrame:
    """One row per cell with its measures from the last write; a row exists where the mask is 1."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*[c.alias(n) for n, c in measures.items()]), order).alias("m"))
    return last.select(*keys, "m.*")


def charset(df: DataFrame, tokens: str) -> DataFrame:
    """Token alphabet with 0-based index."""
    return dense_index(df.select(F.explode(tokens).alias("token")), "token", "idx")


def max_tokens(df: DataFrame, tokens: str) -> DataFrame:
    return df.agg(F.max(F.size(tokens)).alias("max_tokens"))


def one_hot(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Sparse (key, pos, idx) cells equal to 1; all other cells are 0 by absence."""
    index = charset(df, tokens)
    return (df.select(key, F.posexplode(tokens).alias("pos", "token"))
            .join(index, "token").select(key, "pos", "idx"))


def masked_mse(df: DataFrame, label: str = "y", score: str = "s", by: list[str] = []) -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"))


def masked_rmse(df: DataFrame, label: str = "y", score: str = "s", by: list[str] = []) -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def column_stats(train: DataFrame, by: list[str] = ["i"], value: str = "y") -> DataFrame:
    v = F.col(value)
    return train.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"),
        F.max(v).alias("hi"), F.max(F.abs(v)).alias("absmax"))


def select_best(df: DataFrame, keys: list[str], metric: str, order: list[Column]) -> DataFrame:
    """Best metric per key; earlier grid rows win ties."""
    return first_per_key(df, keys, [F.col(metric).desc_nulls_last(), *order])
