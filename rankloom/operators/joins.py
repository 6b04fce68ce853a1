"""Alignment and lookup joins; all are equi-joins Spark may broadcast by measured size."""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.vectors import dot
from rankloom.operators.blocks import block_product
from rankloom.operators.filters import SEGMENT, item_segments
from rankloom.operators.ordering import first_per_key
from rankloom.runtime import shuffle_partitions


def intersect_index(a: DataFrame, b: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """(id, index1, index2) for every matching pair of positions; duplicates fan out."""
    return (a.select(key, F.col(position).alias("index1"))
            .join(b.select(key, F.col(position).alias("index2")), key))


def align(features: DataFrame, response: DataFrame, key: str = "g") -> tuple[DataFrame, DataFrame]:
    """Both tables cut down to the groups they share."""
    return (features.join(response.select(key).distinct(), key, "left_semi"),
            response.join(features.select(key).distinct(), key, "left_semi"))


def align_by_name(a: DataFrame, b: DataFrame, norm, left: str, right: str) -> DataFrame:
    """Inner join on a normalised name; `norm` maps Column to Column."""
    return (a.withColumn("name_key", norm(F.col(left)))
            .join(b.withColumn("name_key", norm(F.col(right))), "name_key"))


def lookup(df: DataFrame, dim: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Matched rows, and a one-row count of the rows without a match."""
    return (df.join(dim, key),
            df.join(dim.select(key), key, "left_anti").agg(F.count("*").alias("unmatched")))


def map_ids(df: DataFrame, mapping: DataFrame, key: str, target: str) -> DataFrame:
    """Replace ids through a dictionary; rows without an entry are dropped."""
    pairs = mapping.select(F.col(key).alias("__k"), F.col(target).alias("__t"))
    return (df.join(pairs, F.col(key) == F.col("__k")).drop("__k")
            .withColumn(key, F.col("__t")).drop("__t"))


def assemble(ids: DataFrame, sources: list[DataFrame], key: str, dedup: bool = False,
             order: list[Column] | None = None) -> DataFrame:
    """Left-join every source onto the ids.  Duplicate keys in a source fan out unless
    `dedup` keeps the first row in `order`."""
    def one(src: DataFrame) -> DataFrame:
        if not dedup:
            return src
        rest = order or [F.col(c).asc_nulls_last() for c in src.columns if c != key]
        return first_per_key(src, [key], rest)
    return reduce(lambda left, src: left.join(one(src), key, "left"), sources, ids)


def flag_members(df: DataFrame, keys: DataFrame, key: str, out: str) -> DataFrame:
    """TRUE for rows whose key is listed, FALSE otherwise, never NULL."""
    hits = keys.select(key).distinct().withColumn(out, F.lit(True))
    return df.join(hits, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def expand_pairs(groups: DataFrame, items: DataFrame, by: str = "g", item: str = "i",
                 width: int = SEGMENT) -> DataFrame:
    """Every group with every item.  Both travel packed, at most `width` to a row: a pack of groups goes
    to each segment of items, and pairs exist only as the result."""
    kind = dict(groups.dtypes)[by]
    packs = (item_segments(items, item, width).groupBy("segment")
             .agg(F.collect_list(item).alias("pack")))  # at most `width` items
    last = packs.agg(F.max("segment")).scalar()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, width):
                part = batch.column(0).slice(lo, width)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["__gs"])

    packed = groups.select(by).mapInArrow(pack, f"__gs array<{kind}>")
    slots = packed.select("__gs", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("segment"))
    # Sizes are estimated before the explode, so that Spark would broadcast the slots.
    met = slots.repartition(shuffle_partitions(groups), "segment").join(packs.hint("merge"), "segment")
    return met.select("pack", F.explode("__gs").alias(by)).select(by, F.explode("pack").alias(item))


def anchor_wins(scored: DataFrame, anchor, items: list, by: str = "g", item: str = "i",
                score: str = "s", missing: float | None = 0.0) -> DataFrame:
    """One row per group and compared item: does the anchor score strictly higher?
    With `missing` set, an absent pair counts as that score."""
    rows = scored.where(F.col(item).isin([anchor, *items])).select(by, item, score)
    value = lambda k: F.max(F.when(F.col(item) == k, F.col(score)))
    if missing is None:
        fill = lambda c: c
    else:
        fill = lambda c: F.coalesce(c, F.lit(float(missing)))
    # One pre-aggregated row per group; the few compared items are literals.
    wide = rows.groupBy(by).agg(fill(value(anchor)).alias("__a"),
                                *[fill(value(k)).alias(f"__s{n}") for n, k in enumerate(items)])
    if missing is not None:
        wide = scored.select(by).distinct().join(wide, by, "left").na.fill(float(missing))
    cells = F.array(*[F.struct(F.lit(k).alias(item), (F.col("__a") > F.col(f"__s{n}")).alias("win"))
                      for n, k in enumerate(items)])
    return wide.select(by, F.explode(cells).alias("c")).select(by, f"c.{item}", "c.win")


def resolve_items(items: DataFrame, wanted: list[str], name: str = "name") -> DataFrame:
    """Items for the wanted names, ignoring case; raises when a name has no item."""
    low = [w.lower() for w in wanted]
    hits = items.where(F.lower(F.col(name)).isin(low))
    # at most len(wanted) names come back
    found = {r[0] for r in hits.select(F.lower(F.col(name))).distinct().collect()}
    absent = [w for w in wanted if w.lower() not in found]
    if absent:
        raise ValueError(f"items not found: {absent}")
    return hits


def merge_maps(a: DataFrame, b: DataFrame, key: str, value: str, known: DataFrame | None = None,
               order: list[Column] | None = None) -> DataFrame:
    """Dictionary union where the second source wins.  Its first row per key counts, and
    only keys missing from `known` (when given) are taken from it."""
    if known is not None:
        b = b.join(known.select(key), key, "left_anti")
    b = first_per_key(b, [key], order or [F.col(value).asc()]).select(key, F.col(value).alias("__new"))
    return (a.select(key, value).join(b, key, "full_outer")
            .select(key, F.coalesce("__new", value).alias(value)))


def attach_names(props: DataFrame, names: DataFrame, key: str = "cid") -> DataFrame:
    return props.join(names, key)


def kernel_predict(kernel: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum over training groups t of k(g, t) * w(t, i)."""
    return block_product(kernel, weights, "g", "t", "i", "k", "w", "s")


def factor_scores(pairs: DataFrame, p: DataFrame, q: DataFrame, mu: float, by: str = "g",
                  item: str = "i", out: str = "s") -> DataFrame:
    """<P_g, Q_i> + mu + b_i for the given pairs.  p holds (g, p), q holds (i, q, b)."""
    return (pairs.join(p, by).join(q, item)
            .select(*pairs.columns, (dot("p", "q") + F.lit(float(mu)) + F.col("b")).alias(out)))


def check_aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Violations of 'same unique keys on both sides' and 'same columns'; no rows if aligned."""
    counts = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = counts(a, "n_left").join(counts(b, "n_right"), key, "full_outer")
    kind = (F.when(F.col("n_left").isNull(), "missing_left")
            .when(F.col("n_right").isNull(), "missing_right")
            .when(F.col("n_left") > 1, "duplicate_left")
            .when(F.col("n_right") > 1, "duplicate_right"))
    bad = both.select(F.col(key).cast("string").alias("subject"), kind.alias("violation")).where(
        F.col("violation").isNotNull())
    odd = sorted(set(a.columns) ^ set(b.columns))
    if odd:
        cols = a.sparkSession.createDataFrame([(c, "column") for c in odd], "subject string, violation string")
        bad = bad.unionByName(cols)
    return bad


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def all_keys(*dfs: DataFrame, key: str) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), [d.select(key) for d in dfs]).distinct()


def ordered_common(listed: DataFrame, a: DataFrame, b: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Listed keys found in both tables, with their list position."""
    return (listed.select(key, position)
            .join(a.select(key), key, "left_semi").join(b.select(key), key, "left_semi"))


def union_tokens(df: DataFrame, tokens: str) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).distinct()


def complement(folds: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Everything outside fold k."""
    return folds.where(F.col(fold) != k)


def sorted_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)
