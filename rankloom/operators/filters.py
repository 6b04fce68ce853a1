"""Filters, projections and reshapes of long tables."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.scalars import is_number, patient_id
from rankloom.operators.ordering import dense_index, first_per_key, grouped_rank
from rankloom.runtime import shuffle_partitions, written

# Index arrays and item packs hold at most this many cells.
SEGMENT = 1024


def normalise_response(resp: DataFrame, thr: DataFrame, item: str = "i", raw: str = "ic50",
                       cut: str = "thr", out: str = "y") -> DataFrame:
    """Distance below the item's threshold."""
    return (resp.join(thr.select(item, cut), item)
            .withColumn(out, F.col(cut) - F.col(raw)).drop(raw, cut))


def shift_nonneg(df: DataFrame, col: str = "y") -> DataFrame:
    """Subtract the global minimum."""
    return df.withColumn(col, F.col(col) - df.agg(F.min(col)).scalar())


def _keep(df: DataFrame, allowed: DataFrame | None, key: str) -> DataFrame:
    return df if allowed is None else df.join(allowed.select(key), key, "left_semi")


def keep_items(df: DataFrame, allowed: DataFrame | None = None, item: str = "i") -> DataFrame:
    return _keep(df, allowed, item)


def keep_features(df: DataFrame, allowed: DataFrame | None = None, feature: str = "f") -> DataFrame:
    return _keep(df, allowed, feature)


def keep_keys_having(df: DataFrame, by: list[str], having: Column, source: DataFrame | None = None) -> DataFrame:
    """Rows whose key satisfies an aggregate condition (counted before any shuffle of rows)."""
    keys = (df if source is None else source).groupBy(*by).agg(having.alias("__ok")).where("__ok").drop("__ok")
    return df.join(keys, by, "left_semi")


def drop_empty_groups(df: DataFrame, by: list[str] = ["g"], label: str = "y") -> DataFrame:
    return keep_keys_having(df, by, F.count(label) > 0)


def restrict_pairs(kernel: DataFrame, groups: DataFrame, left: str = "g1", right: str = "g2",
                   key: str = "g") -> DataFrame:
    """Pairs with both ends among the given groups."""
    live = groups.select(key).distinct()
    return (kernel.join(live.withColumnRenamed(key, left), left, "left_semi")
            .join(live.withColumnRenamed(key, right), right, "left_semi").select(*kernel.columns))


def complete_features(target: DataFrame, other: DataFrame, feature: str = "f",
                      value: str = "x") -> tuple[DataFrame, DataFrame]:
    """Drop features with any missing value in the target, from both tables."""
    whole = (target.groupBy(feature).agg(F.count_if(F.col(value).isNull()).alias("__m"))
             .where("__m = 0").select(feature))
    return target.join(whole, feature, "left_semi"), other.join(whole, feature, "left_semi")


def min_labels(df: DataFrame, by: list[str] = ["g"], n: int = 1, label: str = "y") -> DataFrame:
    """Groups with more than n labels."""
    return keep_keys_having(df, by, F.count(label) > n)


def min_item_labels(train: DataFrame, test: DataFrame, n: int = 2, item: str = "i",
                    label: str = "y") -> tuple[DataFrame, DataFrame]:
    """Items with at least n training labels, in both parts."""
    having = F.count(label) >= n
    return (keep_keys_having(train, [item], having),
            keep_keys_having(test, [item], having, source=train))


def complete_groups(df: DataFrame, required: int, by: list[str] = ["g"], value: str = "x") -> DataFrame:
    return keep_keys_having(df, by, F.count(value) == required)


def extreme_items(df: DataFrame, cutoff: float, item: str = "i", label: str = "y") -> DataFrame:
    return (df.groupBy(item).agg(F.max(label).alias("max_label"))
            .where(F.col("max_label") > cutoff))


def primary_only(df: DataFrame, barcode: str = "id") -> DataFrame:
    """Sample-type digits 14-15 equal to 01."""
    return df.where(F.substring(F.col(barcode), 14, 2) == "01")


def filter_in(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).cast("string").isin([str(v) for v in values]))


def first_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Named rows only, the first row of every key."""
    return first_per_key(df.where(F.col(key).isNotNull()), [key], order)


def drop_text_header(df: DataFrame, ordinal: str, value: str) -> DataFrame:
    """Drop the first row when its value is text."""
    head = (F.col(ordinal) == 1) & F.col(value).isNotNull() & ~is_number(value)
    return df.where(~F.coalesce(head, F.lit(False)))


def valid_symbols(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & (F.col(col) != "?"))


def canonical_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Strip and lower the headers, then rename by alias."""
    names = [c.strip().lower() for c in df.columns]
    return df.toDF(*[aliases.get(n, n) for n in names])


def pick_column(df: DataFrame, candidates: list[str]) -> str:
    """First candidate that exists, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"none of the columns {candidates} exists in {df.columns}")


def transpose(df: DataFrame, key: str, variables: list) -> DataFrame:
    """Variables in rows, samples in columns -> one row per sample, one column per variable."""
    samples = [c for c in df.columns if c != key]
    long = df.unpivot(key, samples, "sample", "value")
    return long.groupBy("sample").pivot(key, variables).agg(F.first("value", ignorenulls=True))


def extract_measure(df: DataFrame, prefix: str, name: str, ordinal: str) -> DataFrame:
    """The first row whose name starts with the prefix, as (sample, value); empty if none."""
    hit = (df.where(F.upper(F.col(name)).startswith(prefix.upper()))
           .orderBy(ordinal).limit(1).drop(ordinal))
    samples = [c for c in hit.columns if c != name]
    return hit.unpivot(name, samples, "sample", "value").drop(name)


def find_ids(df: DataFrame, pattern: str = "^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}") -> DataFrame:
    """Distinct ids found in any text column."""
    texts = [c for c, t in df.dtypes if t == "string"]
    cell = F.explode(F.array(*[F.col(c) for c in texts])).alias("cell")
    return (df.select(cell).where(F.col("cell").rlike(pattern))
            .select(patient_id("cell").alias("id")).distinct())


def reorder_items(items: DataFrame, priority: DataFrame, item: str = "i", position: str = "pos") -> DataFrame:
    """Listed items first in list order, the rest in their old order; new 0-based `pos`."""
    front = priority.select(item, F.col(position).alias("__p"))
    ranked = grouped_rank(items.join(front, item, "left"), [],
                          [F.col("__p").asc_nulls_last(), F.col(position).asc()], "__r")
    return ranked.withColumn(position, F.col("__r") - 1).drop("__r", "__p")


def observed_positions(df: DataFrame, by: str = "g", item: str = "i", label: str = "y") -> DataFrame:
    """0-based (row, col) of observed cells; indices cover every key, observed or not."""
    rows = dense_index(df, by, "row")
    cols = dense_index(df, item, "col")
    return (df.where(F.col(label).isNotNull()).select(by, item)
            .join(rows, by).join(cols, item).select("row", "col"))


def observed_index_array(df: DataFrame, by: str = "g", item: str = "i", label: str = "y",
                         width: int = SEGMENT) -> DataFrame:
    """Indices of the observed items of each group in order, packed in arrays of `width`
    cells; the last array of a group is padded with -1."""
    cols = dense_index(df, item, "idx")
    hits = df.where(F.col(label).isNotNull()).select(by, item).join(cols, item)
    slots = grouped_rank(hits, [by], [F.col("idx").asc()], "__slot")
    packed = (slots.groupBy(by, F.floor((F.col("__slot") - 1) / width).alias("segment"))
              .agg(F.sort_array(F.collect_list("idx")).alias("__a")))  # at most `width` cells
    pad = F.array_repeat(F.lit(-1).cast("long"), F.lit(width) - F.size("__a"))
    return packed.select(by, "segment", F.concat("__a", pad).alias("indices"))


def results_long(wide: DataFrame, keys: list[str], ks: list[int], methods: list[str] | None = None,
                 ratios: list[float] | None = None, ratio_transform=None) -> DataFrame:
    """Wide metric columns ndcg_k / precision_k -> one row per (keys, k); optional ranges and
    a Column -> Column change of the ratio."""
    if methods is not None:
        wide = wide.where(F.col("method").isin(methods))
    if ratios is not None:
        wide = wide.where(F.col("ratio").isin(ratios))
    cells = F.explode(F.array(*[F.struct(
        F.lit(k).alias("rank_k"), F.col(f"ndcg_{k}").alias("ndcg"),
        F.col(f"precision_{k}").alias("precision")) for k in ks])).alias("c")
    long = wide.select(*keys, cells).select(*keys, "c.*")
    if ratio_transform is not None:
        long = long.withColumn("ratio", ratio_transform(F.col("ratio")))
    return long


def item_segments(items: DataFrame, item: str, width: int = SEGMENT) -> DataFrame:
    """Distinct items with index, segment and offset inside the segment."""
    return (dense_index(items, item, "idx")
            .withColumn("segment", F.floor(F.col("idx") / width))
            .withColumn("offset", F.col("idx") % width))


def missing_cells(df: DataFrame, by: str = "g", item: str = "i", value: str = "y",
                  items: DataFrame | None = None, width: int = SEGMENT) -> DataFrame:
    """The (group, item) cells of the full matrix that hold no value."""
    return _absent_cells(written(df.select(by, item, value)), by, item, value, items, width)


def _absent_cells(rows: DataFrame, by: str, item: str, value: str, items: DataFrame | None, width: int) -> DataFrame:
    """Missing cells of a written table.

    Groups and items are packed into blocks of about `width` by their hashes.  A task holds one
    block of items, and blocks of groups and the cells observed there pass by, so the full matrix
    exists only as the result and no row of it is shuffled."""
    kinds = dict(rows.dtypes)
    listed = (rows if items is None else items).select(item).where(F.col(item).isNotNull()).distinct()
    if items is not None:
        listed = written(listed)
        kinds[item] = dict(items.dtypes)[item]
    groups = rows.select(by).distinct()
    tasks = shuffle_partitions(rows)
    n_groups, n_items = groups.count(), listed.count()
    least = max(1, min(width, n_items // (2 * tasks)))
    gbs, ibs = max(1, -(-n_groups // width)), max(1, -(-n_items // least))
    spot = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast(kinds[key])), F.lit(n)).cast("int")
    none = lambda key: F.lit(None).cast(f"array<{kinds[key]}>")
    packs = (listed.groupBy(spot(item, ibs).alias("ib")).agg(F.collect_list(item).alias("is"))  # about `width` items
             .select("ib", F.lit(-1).alias("gb"), F.lit(0).alias("kind"), none(by).alias("gs"), "is"))
    frame = (groups.where(F.col(by).isNotNull()).groupBy(spot(by, gbs).alias("gb")).agg(F.collect_list(by).alias("gs"))  # likewise
             .select(F.explode(F.sequence(F.lit(0), F.lit(ibs - 1))).alias("ib"), "gb", F.lit(1).alias("kind"), "gs", none(item).alias("is")))
    cells = (rows.where(F.col(value).isNotNull() & F.col(by).isNotNull() & F.col(item).isNotNull()).select(by, F.col(item).cast(kinds[item])).distinct()
             .groupBy(spot(item, ibs).alias("ib"), spot(by, gbs).alias("gb")).agg(F.collect_list(F.struct(by, item)).alias("c"))  # a block's cells
             .select("ib", "gb", F.lit(0).alias("kind"), F.col(f"c.{by}").alias("gs"), F.col(f"c.{item}").alias("is")))

    def absent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, found, have = -1, None, None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                ib, gb, kind, gs, own = r
                if gb < 0:
                    at, ids, found, have = ib, np.asarray(own), pd.Index(own), None
                elif ib != at:
                    continue  # cells of items that aren't listed
                elif kind == 0:
                    have = (gb, gs, own)
                else:
                    empty = np.ones((len(gs), len(ids)), dtype=bool)
                    if have is not None and have[0] == gb:
                        g, i = pd.Index(gs).get_indexer(have[1]), found.get_indexer(have[2])
                        empty[g[i >= 0], i[i >= 0]] = False
                    yield pd.DataFrame({by: gs, "is": [ids[e] for e in empty]})

    parts = packs.unionByName(frame).unionByName(cells).repartition(tasks, "ib").sortWithinPartitions("ib", "gb", "kind")
    full = parts.mapInPandas(absent, f"`{by}` {kinds[by]}, is array<{kinds[item]}>").select(by, F.explode("is").alias(item))
    # the NULL group matches no cell, so it misses all
    nulls = groups.where(F.col(by).isNull()).crossJoin(listed.select(F.col(item).cast(kinds[item]).alias(item)))
    return full.unionByName(nulls)


def fill_labels(df: DataFrame, fill: float = 0.0, by: str = "g", item: str = "i", label: str = "y") -> DataFrame:
    """Every (group, item) cell with missing labels set to `fill`."""
    rows = written(df.select(by, item, label))
    empty = _absent_cells(rows, by, item, label, None, SEGMENT).select(by, item, F.lit(float(fill)).alias(label))
    return rows.where(F.col(label).isNotNull()).unionByName(empty)
