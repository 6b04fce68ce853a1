"""Matrices as tables of blocks: sums of partial blocks and products of sparse tables."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.runtime import shuffle_partitions

# Rows, inner keys and columns of a block of a sparse product: three dense squares of these sides in a task.
SIDE = 1024


def summed(parts: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """(key, moments): element-wise sum of the equally long arrays of each key, added as they stream
    by; in the order of `at` where it is given, so that the same parts give the same last bit."""
    types = dict(parts.dtypes)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                if total is not None and keys[lo] != held:
                    yield pd.DataFrame({key: [held], "moments": [total]})
                    total = None
                for row in pdf["moments"].iloc[lo:hi]:
                    total = row.copy() if total is None else total + row
                held = keys[lo]
        if total is not None:
            yield pd.DataFrame({key: [held], "moments": [total]})

    order = [key] if at is None else [key, at]
    ordered = parts.repartition(shuffle_partitions(parts), key).sortWithinPartitions(*order)
    return ordered.select(key, "moments").mapInPandas(add, f"{key} {types[key]}, moments array<double>")


def _codes(values: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the place of each row's value among them."""
    coded = values.combine_chunks().dictionary_encode() if values.num_chunks != 1 else values.chunk(0).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _dense(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the values of each cell."""
    return np.bincount(rows * shape[1] + cols, weights=values, minlength=shape[0] * shape[1]).reshape(shape)


def _blocks_of(df: DataFrame, *keys: str, side: int) -> list[int]:
    """Numbers of blocks by hash, so that a block has about `side` distinct keys."""
    counts = df.agg(*[F.approx_count_distinct(k) for k in keys]).first()
    return [max(1, math.ceil(n / side)) for n in counts]


def block_product(a: DataFrame, b: DataFrame, row: str, inner: str, col: str, left: str, right: str, out: str,
                  only: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """(row, col, out): sum over `inner` of a(row, inner, left) * b(inner, col, right), as a join and a
    sum would give it, without a row for every product.

    Both tables are dealt into blocks by hashes of their keys.  Two blocks that share inner keys
    meet once, in a cogroup, as dense matrices; what they add to a cell of the result is one row,
    and cells are added up over the inner blocks.  A cell exists where an inner key has both sides,
    and is NULL where no product has two values.  `only` (row, col) limits the cells that leave a
    task to its pairs.  Rows with a NULL key match nothing, as in a join."""
    kinds = {row: dict(a.dtypes)[row], inner: dict(a.dtypes)[inner], col: dict(b.dtypes)[col]}
    a = a.select(F.col(row).alias("r"), F.col(inner).alias("s"), F.col(left).cast("double").alias("v")).where("r IS NOT NULL AND s IS NOT NULL")
    b = b.select(F.col(inner).cast(kinds[inner]).alias("s"), F.col(col).alias("c"), F.col(right).cast("double").alias("v")).where("s IS NOT NULL AND c IS NOT NULL")
    (nr, ns), (nc,) = _blocks_of(a, "r", "s", side=side), _blocks_of(b, "c", side=side)
    spot = lambda key, n, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    lefts = a.select(spot("r", nr, 1).alias("rb"), spot("s", ns, 2).alias("sb"), every(nc).alias("cb"), "r", "s", none(kinds[col]).alias("c"), "v")
    if only is not None:
        pairs = only.select(F.col(row).cast(kinds[row]).alias("r"), F.col(col).cast(kinds[col]).alias("c")).where("r IS NOT NULL AND c IS NOT NULL")
        lefts = lefts.unionByName(pairs.select(spot("r", nr, 1).alias("rb"), every(ns).alias("sb"), spot("c", nc, 3).alias("cb"), "r",
                                               none(kinds[inner]).alias("s"), "c", none("double").alias("v")))
    rights = b.select(every(nr).alias("rb"), spot("s", ns, 2).alias("sb"), spot("c", nc, 3).alias("cb"), "s", "c", "v")

    limited = only is not None

    def multiply(x: pa.Table, y: pa.Table) -> pa.Table:
        wanted = x.filter(pc.is_null(x.column("s"))) if limited else None
        x = x.filter(pc.is_valid(x.column("s")))
        if not (x.num_rows and y.num_rows) or (wanted is not None and not wanted.num_rows):
            return pa.table({"r": x.column("r").slice(0, 0), "c": y.column("c").slice(0, 0), "w": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        (r_keys, r), (c_keys, c) = _codes(x.column("r")), _codes(y.column("c"))
        s_keys, s = _codes(x.column("s"))
        t = pc.index_in(y.column("s").combine_chunks(), s_keys)
        met = pc.is_valid(t).to_numpy(zero_copy_only=False)
        t, c = t.fill_null(0).to_numpy()[met], c[met]
        xv, yv = (z.column("v").combine_chunks() for z in (x, y))
        x_real, y_real = (pc.is_valid(v).to_numpy(zero_copy_only=False) for v in (xv, yv))
        xv, yv = (v.fill_null(0.0).to_numpy() for v in (xv, yv))
        yv, y_real = yv[met], y_real[met]
        left_shape, right_shape = (len(r_keys), len(s_keys)), (len(s_keys), len(c_keys))
        value = _dense(r, s, xv, left_shape) @ _dense(t, c, yv, right_shape)
        real = _dense(r, s, x_real, left_shape) @ _dense(t, c, y_real, right_shape)
        exists = real if x_real.all() and y_real.all() else _dense(r, s, np.ones(len(r)), left_shape) @ _dense(t, c, np.ones(len(c)), right_shape)
        if wanted is None:
            rows, cols = np.nonzero(exists)
        else:
            rows, cols = (pc.index_in(wanted.column(k).combine_chunks(), keys) for k, keys in (("r", r_keys), ("c", c_keys)))
            both = pc.and_(pc.is_valid(rows), pc.is_valid(cols)).to_numpy(zero_copy_only=False)
            rows, cols = rows.fill_null(0).to_numpy()[both], cols.fill_null(0).to_numpy()[both]
            cells = np.unique(rows.astype(np.int64) * len(c_keys) + cols)
            rows, cols = cells // len(c_keys), cells % len(c_keys)
            there = exists[rows, cols] > 0
            rows, cols = rows[there], cols[there]
        return pa.table({"r": r_keys.take(pa.array(rows)), "c": c_keys.take(pa.array(cols)),
                         "w": pa.array(value[rows, cols], pa.float64()), "n": pa.array(np.rint(real[rows, cols]).astype(np.int64))})

    keys = ["rb", "sb", "cb"]
    parts = lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(multiply, f"r {kinds[row]}, c {kinds[col]}, w double, n long")
    worth: Column = F.when(F.col("n") > 0, F.col("w"))
    if ns > 1:
        parts = parts.groupBy("r", "c").agg(F.sum(worth).alias("w"), F.sum("n").alias("n"))
    return parts.select(F.col("r").alias(row), F.col("c").alias(col), worth.alias(out))
