"""Fold reports and method comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.operators.metrics import cutoff_metrics


def fold_report(per_group: DataFrame, metrics: list[str], keys: list[str] = ["method"],
                fold: str = "fold", foldwise: bool = True) -> DataFrame:
    """Mean over the groups of each fold, then over folds; or over all groups at once."""
    if not foldwise:
        return per_group.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
    folds = per_group.groupBy(*keys, fold).agg(*[F.avg(m).alias(m) for m in metrics])
    return folds.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def compare_methods(scored: DataFrame, ks: list[int], keys: list[str] = ["method"], fold: str = "fold",
                    group: str = "g", foldwise: bool = True) -> DataFrame:
    """One row per method with NDCG and precision at every k: all methods, folds and cut-offs
    are computed in the same pass."""
    per = cutoff_metrics(scored, ks, [*keys, fold, group])
    wanted = [f"{m}_{k}" for k in ks for m in ("ndcg", "precision")]
    return fold_report(per, wanted, keys, fold, foldwise)


def evaluate(scored: DataFrame, k: int, by: list[str] = ["g"]) -> DataFrame:
    """Mean NDCG, DCG and ideal DCG over all groups."""
    per = cutoff_metrics(scored, [k], by)
    return per.agg(F.avg(f"ndcg_{k}").alias("ndcg"), F.avg(f"dcg_{k}").alias("dcg"),
                   F.avg(f"idcg_{k}").alias("idcg"))


def format_report(folds: DataFrame, keys: list[str], metric: str, value: str, fold: str = "fold") -> DataFrame:
    """One text line per key: keys, metric, mean, then the fold values in order."""
    fmt = lambda c: F.format_string("%.6f", c)
    row = folds.groupBy(*keys).agg(
        F.avg(value).alias("__m"),
        F.sort_array(F.collect_list(F.struct(F.col(fold), F.col(value).alias("v")))).alias("__f"))  # one per fold
    values = F.array_join(F.transform("__f", lambda r: fmt(r["v"])), " ")
    return row.select(*keys, F.concat_ws(" ", *keys, F.lit(metric),
                                         F.concat(F.lit("mean_"), fmt(F.col("__m"))), values).alias("line"))
