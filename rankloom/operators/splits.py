"""Splits and samples driven by keyed digests: no row is drawn twice differently."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.random import key_hash, uniform
from rankloom.functions.scalars import nan_to_null
from rankloom.operators.ordering import exact_median, grouped_rank, hash_rank, score_order, tile, top_k
from rankloom.operators.filters import keep_keys_having, min_item_labels
from rankloom.runtime import join_groups


def kfold(groups: DataFrame, k: int, seed=0, key: str = "g", within: str | None = None,
          out: str = "fold") -> DataFrame:
    """Shuffled folds whose sizes differ by at most one.  With `within`, the groups are split
    again separately for every value of that column (inner folds stay inside it)."""
    keys = groups.select(*([within] if within else []), key).distinct()
    ranked = hash_rank(keys, key, seed, "__rn", "__n", [within] if within else [])
    return ranked.withColumn(out, tile(F.col("__rn"), F.col("__n"), k)).drop("__rn", "__n")


def nested_folds(folds: DataFrame, k: int, seed=0, key: str = "g") -> DataFrame:
    """Inner folds of the training side of every outer fold: (outer, g, fold)."""
    outer = folds.select(F.col("fold").alias("held"), key)
    k_outer = folds.select("fold").distinct().withColumnRenamed("fold", "outer")
    # Every group trains in all folds but its own; the fold list has k rows.
    packed = k_outer.agg(F.sort_array(F.collect_list("outer"))).scalar()
    train = (outer.withColumn("outer", F.explode(packed)).where(F.col("outer") != F.col("held"))
             .select("outer", key))
    return kfold(train, k, seed, key, within="outer")


def fold_views(kernel: DataFrame, folds: DataFrame, fold: int, left: str = "g1", right: str = "g2",
               key: str = "g") -> tuple[DataFrame, DataFrame]:
    """(train x train, test x train) parts of a pair table for one held-out fold."""
    l = folds.select(F.col(key).alias(left), F.col("fold").alias("__fl"))
    r = folds.select(F.col(key).alias(right), F.col("fold").alias("__fr"))
    tagged = kernel.join(l, left).join(r, right).where(F.col("__fr") != fold)
    cols = kernel.columns
    return (tagged.where(F.col("__fl") != fold).select(*cols),
            tagged.where(F.col("__fl") == fold).select(*cols))


def holdout(groups: DataFrame, frac: float, seed=0, key: str = "g") -> DataFrame:
    """`is_val` for max(1, n * frac rounded half to even) random groups."""
    ranked = hash_rank(groups.select(key).distinct(), key, seed, "__rn", "__n")
    n_val = F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(frac), 0))
    return ranked.withColumn("is_val", F.col("__rn") <= n_val).drop("__rn", "__n")


def top_fraction(df: DataFrame, ratio: float, by: list[str] = ["g"], item: str = "i",
                 label: str = "y", items: DataFrame | None = None) -> DataFrame:
    """Per group, the first int(ratio * number of all items) observed rows by label."""
    total = (df if items is None else items).agg(F.count_distinct(F.col(item))).scalar()
    ranked = grouped_rank(df.where(F.col(label).isNotNull()), by, score_order(label, item), "__r")
    return ranked.where(F.col("__r") <= F.floor(total * F.lit(ratio))).drop("__r")


def keep_k(train: DataFrame, test: DataFrame, ratio: float, q: int, seed=0, by: list[str] = ["g"],
           item: str = "i", label: str = "y") -> tuple[DataFrame, DataFrame]:
    """Per training group keep q random rows among its top fraction; then keep the items with
    more than one training label on both sides."""
    best = top_fraction(train, ratio, by, item, label, items=train)
    drawn = top_k(best.withColumn("__h", key_hash(seed, *by, item)), by,
                  [F.col("__h").asc(), F.col(item).asc()], q, "__d").drop("__h", "__d")
    return min_item_labels(drawn, test, 2, item, label)


def bootstrap(groups: DataFrame, p: float, seed=0, key: str = "g") -> DataFrame:
    """floor(n * p) draws with replacement: (draw, g)."""
    rows = hash_rank(groups.select(key).distinct(), key, f"{seed}:order", "__rn", "__n")
    total = groups.agg(F.count_distinct(F.col(key))).scalar()
    spark = groups.sparkSession
    m = math.floor(groups.agg(F.count_distinct(F.col(key))).first()[0] * p + 1e-9)
    draws = spark.range(m).withColumnRenamed("id", "draw")
    picked = draws.withColumn("__rn", (F.floor(uniform(seed, "draw") * total) + 1).cast("long"))
    return picked.join(rows.select(key, "__rn"), "__rn").select("draw", key)


def mask_labels(df: DataFrame, rate: float, seed=0, by: list[str] = ["g"], item: str = "i",
                label: str = "y") -> DataFrame:
    """Blank each label with the given probability."""
    return df.withColumn(label, F.when(uniform(seed, *by, item) >= rate, F.col(label)))


def sensitive(df: DataFrame, item: str = "i", label: str = "y") -> DataFrame:
    """Label above the item's exact median, with the sign of the signal."""
    med = exact_median(df, [item], label, "__m")
    above = F.col(label) > F.col("__m")
    return (join_groups(df, med, [item]).where(F.col(label).isNotNull())
            .withColumn("sensitive", above)
            .withColumn("signal", F.when(above, 1).otherwise(-1)).drop("__m"))


def expanding_cohort(groups: DataFrame, start: float = 0.5, step: int = 20, seed=0,
                     key: str = "g") -> DataFrame:
    """First step at which a training group is used: step 0 holds the starting share and every
    later step adds `step` groups.  Step t trains on the rows with step_id <= t."""
    ranked = hash_rank(groups.select(key).distinct(), key, seed, "__rn", "__n")
    late = F.ceil((F.col("__rn") - F.floor(F.col("__n") * F.lit(start))) / F.lit(step))
    return ranked.withColumn("step_id", F.greatest(F.lit(0), late)).drop("__rn", "__n")


def median_ge0_items(df: DataFrame, item: str = "i", label: str = "y") -> DataFrame:
    return exact_median(df, [item], label, "median").where("median >= 0").select(item)


def fold_tables(features: DataFrame, response: DataFrame, folds: DataFrame, fold: int,
                key: str = "g") -> dict[str, DataFrame]:
    """Train and test sides of one fold as filters over the stored tables."""
    test = folds.where(F.col("fold") == fold).select(key)
    train = folds.where(F.col("fold") != fold).select(key)
    cut = lambda df, keys: df.join(keys, key, "left_semi")
    return {"x_train": cut(features, train), "x_test": cut(features, test),
            "y_train": cut(response, train), "y_test": cut(response, test)}
