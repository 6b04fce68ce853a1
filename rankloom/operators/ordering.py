"""Ranks, top-k and exact medians that never depend on one group fitting in a task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.random import key_hash
from rankloom.runtime import durable, hot_groups, join_groups, shuffle_partitions

# Spark cuts groups on the map side up to this k (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# Rows of a bucket of a random order, on average at most.
BUCKET_ROWS = 1_000_000


def score_order(score: str, item: str = "i") -> list[Column]:
    """Descending score, missing scores last, ties by ascending item key."""
    return [F.col(score).desc_nulls_last(), F.col(item).asc()]


COUNT = object()


def grouped_rank(df: DataFrame, by: list[str], order: list[Column], out: str = "rank",
                 hot_rows: int | None = None, hot: DataFrame | None | object = COUNT) -> DataFrame:
    """1-based row number per group.

    Ordinary groups use a window.  Groups found to be hot are range-partitioned on the
    order itself, numbered piece by piece, and shifted by the rows in earlier pieces.  The hot
    groups are counted, unless the caller has them from `hot_groups`."""
    if not by:
        return _ranged_rank(df, [], order, out)
    window = Window.partitionBy(*by).orderBy(*order)
    if hot is COUNT:
        hot = hot_groups(df, by, hot_rows)
    if hot is None:
        return df.withColumn(out, F.row_number().over(window).cast("long"))
    cold = join_groups(df, hot, by, "left_anti").withColumn(out, F.row_number().over(window).cast("long"))
    ranked = _ranged_rank(join_groups(df, hot, by, "left_semi"), by, order, out)
    return cold.unionByName(ranked)


def _ranged_rank(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    cols = df.columns
    # The partition number is part of the result below, so it is pinned in storage:
    # recomputing a range shuffle may cut the ranges elsewhere.
    pieces = durable(
        df.repartitionByRange(shuffle_partitions(df), *[F.col(c) for c in by], *order)
        .withColumn("__piece", F.spark_partition_id()))
    sizes = pieces.groupBy("__piece", *by).agg(F.count("*").alias("__size"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__piece")
    shifts = sizes.select(
        "__piece", *by,
        F.coalesce(F.sum("__size").over(before.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__shift"))
    local = Window.partitionBy("__piece", *by).orderBy(*order)
    return (join_groups(pieces.withColumn("__local", F.row_number().over(local)), shifts, ["__piece", *by])
            .select(*cols, (F.col("__local") + F.col("__shift")).cast("long").alias(out)))


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based index of every distinct key in key order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return grouped_rank(keys, [], [F.col(key).asc()], out).withColumn(out, F.col(out) - 1)


def hash_rank(df: DataFrame, key: str, seed, out: str = "rn", total: str = "n",
              by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """1-based position of every row in a keyed random order, with the row count.

    The digest is uniform, so its first hex digits cut the order into equal buckets; the
    bucket counts give each bucket its offset.  There are as many digits as buckets of at most
    BUCKET_ROWS rows need, by a count of the rows."""
    by = by or []
    if digits is None:
        digits = max(2, math.ceil(math.log(max(1, df.count() / BUCKET_ROWS), 16)))
    tagged = (df.withColumn("__h", key_hash(seed, *by, key))
              .withColumn("__b", F.substring("__h", 1, digits)))
    counts = tagged.groupBy(*by, "__b").agg(F.count("*").alias("__size"))
    line = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    shifts = counts.select(
        *by, "__b",
        F.coalesce(F.sum("__size").over(line.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__shift"),
        F.sum("__size").over(line).alias(total))
    local = Window.partitionBy(*by, "__b").orderBy("__h", key)
    return (tagged.withColumn("__local", F.row_number().over(local))
            .transform(lambda d: join_groups(d, shifts, [*by, "__b"]))
            .withColumn(out, (F.col("__local") + F.col("__shift")).cast("long"))
            .drop("__h", "__b", "__local", "__shift"))


def tile(position: Column, total: Column, k: int) -> Column:
    """0-based tile of a 1-based position: tile sizes differ by at most one, longer first."""
    size = F.floor(total / k)
    extra = total % k
    head = extra * (size + 1)
    return F.when(position <= head, F.floor((position - 1) / (size + 1))).otherwise(
        extra + F.floor((position - 1 - head) / F.greatest(size, F.lit(1)))).cast("int")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group; Spark keeps at most k rows per group and map task before
    the shuffle, so a hot group shrinks where it is read."""
    if k > GROUP_LIMIT:
        return grouped_rank(df, by, order, out).filter(F.col(out) <= k)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1, "__first").drop("__first")


def exact_median(df: DataFrame, by: list[str], value: str, out: str = "median",
                 hot_rows: int | None = None) -> DataFrame:
    """Interpolated median of the non-missing values, by rank rather than by holding the
    values of a group in memory.  Equal values are counted first, so the ranks run over
    distinct values only."""
    present = df.where(F.col(value).isNotNull())
    spots = (present.groupBy(*by, value).agg(F.count("*").alias("__m")))
    if not by:
        spots, by, plain = spots.withColumn("__all", F.lit(1)), ["__all"], True
    else:
        plain = False
    running = _running_count(spots, by, value, hot_rows)
    total = spots.groupBy(*by).agg(F.sum("__m").alias("__t"))
    lo = F.floor((F.col("__t") + 1) / 2)
    hi = F.ceil((F.col("__t") + 1) / 2)
    covers = lambda r: (F.col("__end") - F.col("__m") < r) & (r <= F.col("__end"))
    med = (join_groups(running, total, by)
           .where(covers(lo) | covers(hi))
           .groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias(out)))
    return med.drop("__all") if plain else med


def _running_count(spots: DataFrame, by: list[str], value: str, hot_rows: int | None) -> DataFrame:
    """Count of rows up to and including each distinct value of a group, in `__end`."""
    hot = hot_groups(spots, by, hot_rows)
    window = Window.partitionBy(*by).orderBy(value)
    if hot is None:
        return spots.withColumn("__end", F.sum("__m").over(window))
    cold = join_groups(spots, hot, by, "left_anti").withColumn("__end", F.sum("__m").over(window))
    pieces = durable(
        join_groups(spots, hot, by, "left_semi")
        .repartitionByRange(shuffle_partitions(spots), *by, value)
        .withColumn("__piece", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (pieces.groupBy("__piece", *by).agg(F.sum("__m").alias("__s"))
              .select("__piece", *by, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__shift")))
    local = Window.partitionBy("__piece", *by).orderBy(value)
    warm = (pieces.withColumn("__run", F.sum("__m").over(local))
            .transform(lambda d: join_groups(d, shifts, ["__piece", *by]))
            .select(*spots.columns, (F.col("__run") + F.col("__shift")).alias("__end")))
    return cold.unionByName(warm)
