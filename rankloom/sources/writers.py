"""Writers: bundles, compressed CSV, and the prediction store keyed by run."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.runtime import join_groups
from rankloom.sources.readers import _exists


def save_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_scored(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append predictions under one folder per run.  Rows are gathered per run, so a small run
    writes one file, and adaptive execution splits a run too large for one task."""
    df.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(path)


def missing_runs(grid: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Grid rows not yet in the store.  Folder names are listed, one per run; no file is opened."""
    spark = grid.sparkSession
    if not _exists(spark, path):
        return grid
    types = dict(grid.dtypes)
    done = spark.createDataFrame(_stored_runs(spark, path, keys), ", ".join(f"`{k}` string" for k in keys))
    done = done.select(*[F.col(k).cast(types[k]).alias(k) for k in keys])
    return join_groups(grid, done, keys, "left_anti")


def _stored_runs(spark: SparkSession, path: str, keys: list[str]) -> list[tuple]:
    """The run of every folder key=value/key=value/... below the store."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *[f"{k}=*" for k in keys]]))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    runs = []
    for status in found or []:
        parts = status.getPath().toString().split("/")[-len(keys):]
        values = [unquote(p.partition("=")[2]) for p in parts]
        runs.append(tuple(None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values))
    return runs


def append_epoch_log(df: DataFrame, path: str) -> None:
    cols = ["epoch", "train_ndcg", "train_rewards", "test_ndcg", "test_rewards"]
    df.select(*cols).write.mode("append").csv(path)
