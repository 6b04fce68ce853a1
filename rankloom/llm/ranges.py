"""Rows dealt into ranges of an integer key, each range handled by one call."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.common import group_count

# Stands for a null key: before all others in descending order last, in ascending order first.
NO_KEY = -(1 << 63)


def rows_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, key, text, h): k is never null; h breaks ties of the key."""
    return df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("k"), F.col(key).cast("bigint").alias("key"),
                     F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def edges_of(df: DataFrame, rows: DataFrame) -> np.ndarray:
    """Descending keys that cut the rows into ranges of like size: one number per range."""
    parts = group_count(df)
    cuts = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return np.unique(np.array(cuts or [], dtype=np.int64))[::-1]


def range_of(edges: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The range of each key; range 0 has the largest keys."""
    return len(edges) - np.searchsorted(edges[::-1], keys, side="right")


def dealt(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """The rows with `part`, counted from the smallest keys on."""
    share = rows.sparkSession.sparkContext.broadcast(edges)

    def place(batches):
        for batch in batches:
            parts = len(share.value) - range_of(share.value, batch.column("k").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    return rows.mapInArrow(place, "part int, k long, key long, text string, h long")
