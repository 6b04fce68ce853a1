"""Similarity kernels between samples.

A kernel is one value per pair of samples, so its cost is the number of pairs whatever the
engine.  Vectors are packed into blocks of at most BLOCK rows; a block meets every other
block once in an equi-join on block numbers, and matrix products of a strip of rows of one with the
other yield their tile.  No task sees more than two blocks and a strip, whatever the number of
rows of a block, and no key gathers more than its block's rows."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rankloom.functions.vectors import centred, norm, spread
from rankloom.runtime import written

# Bytes of the vectors of a block; two blocks meet in a task.
BLOCK_BYTES = 16 * 1024 * 1024
# Values of a tile that exist at a time.
STRIP_CELLS = 1 << 19
# Tiles that keep the cores busy.
TILES_PER_CORE = 3


def standardised(vec: DataFrame, key: str = "g", col: str = "x", zero_std: str = "one") -> DataFrame:
    """Each sample's vector minus its mean over its population std, scaled so that a dot
    product of two results is their Pearson correlation.  A zero std counts as 1
    (correlation 0), or gives a NULL vector with zero_std="null"."""
    if zero_std not in ("one", "null"):
        raise ValueError(f"unknown zero_std {zero_std!r}")
    rows = vec.select(key, centred(col).alias("__c"), F.aggregate(
        col, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double")))).alias("__top"))
    rows = rows.withColumn("__len", norm("__c"))
    # Rounding leaves a constant vector with a length of a few last bits.
    flat = F.col("__len") <= F.col("__top") * F.sqrt(F.size("__c")) * F.lit(1e-14)
    length = F.when(flat, 1.0).otherwise(F.col("__len"))
    zeros = F.array_repeat(F.lit(0.0), F.size("__c"))
    z = F.zip_with("__c", spread(length, "__c"), lambda x, n: x / n)
    flat_value = F.lit(None).cast("array<double>") if zero_std == "null" else zeros
    return rows.select(key, F.when(flat, flat_value).otherwise(z).alias(col))


def _measured(vec: DataFrame, col: str) -> tuple[int, int]:
    """(vectors, bytes)"""
    n, d = vec.agg(F.count("*"), F.max(F.size(col))).first()
    return n, 8 * n * (d or 1)


def _packed(vec: DataFrame, key: str, col: str, blocks: int) -> DataFrame:
    """(b, ids, flat): vectors dealt to so many rows, flattened."""
    rows = vec.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"),
                      F.struct(F.col(key).alias("id"), F.col(col).alias("v")).alias("r"))
    packs = rows.groupBy("b").agg(F.collect_list("r").alias("rs"))  # BLOCK_BYTES, or `block` rows, on average at most
    return packs.select("b", F.col("rs.id").alias("ids"), F.flatten("rs.v").alias("flat"))


def _met(a: DataFrame, b: DataFrame | None, key: str, col: str, block: int | None, sized: DataFrame | None = None) -> DataFrame:
    """(b, ids1, flat1, b2, ids2, flat2): every two blocks that meet, one row each.

    A block is sent to all it meets, so there are no more blocks than `block` or BLOCK_BYTES ask for
    and than TILES_PER_CORE tiles need; the larger of two sets is cut into more.  `sized` has as many
    vectors as a, as long, and is cheaper to count."""
    spark = a.sparkSession
    tiles = min(int(spark.conf.get("spark.sql.shuffle.partitions")), TILES_PER_CORE * spark.sparkContext.defaultParallelism)

    def count(size: tuple[int, int], least: int) -> int:
        return max(1, -(-size[0] // block) if block else max(-(-size[1] // BLOCK_BYTES), min(least, size[0] // 64)))

    size = _measured(a if sized is None else sized, col)
    if b is None:
        nl = nr = count(size, math.ceil(math.sqrt(2 * tiles)))
    else:
        other = _measured(b, col)
        nl = count(size, math.ceil(math.sqrt(tiles * size[1] / max(1, other[1]))))
        nr = count(other, -(-tiles // nl))
    left = _packed(a, key, col, nl)
    right = left if b is None else _packed(b, key, col, nr)
    lowest = F.col("b") if b is None else F.lit(0)
    highest = F.col("b2") if b is None else F.lit(nl - 1)
    # Both sides go straight to the task of their tile (b, b2).  The merge hint keeps a small
    # kernel from being broadcast into a single task.
    lefts = left.select("b", F.explode(F.sequence(lowest, F.lit(nr - 1))).alias("b2"),
                        F.col("ids").alias("ids1"), F.col("flat").alias("flat1"))
    rights = right.withColumnRenamed("b", "b2").select(
        F.explode(F.sequence(F.lit(0), highest)).alias("b"), "b2",
        F.col("ids").alias("ids2"), F.col("flat").alias("flat2"))
    return lefts.join(rights.hint("merge"), ["b", "b2"])


def _strips(batches: Iterator[pa.RecordBatch], tile_fn) -> Iterator[tuple]:
    """(ids of rows, ids of columns, values, off the diagonal, vectors of both) of some rows of a tile at a time."""
    for batch in batches:
        row = {name: batch.column(n) for n, name in enumerate(batch.schema.names)}
        for n in range(batch.num_rows):
            ids1, ids2 = row["ids1"][n].values, row["ids2"][n].values
            x, y = (row[c][n].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c, ids in (("flat1", ids1), ("flat2", ids2)))
            off = row["b"][n].as_py() != row["b2"][n].as_py()
            step = max(1, STRIP_CELLS // len(ids2))
            for lo in range(0, len(ids1), step):
                yield ids1.slice(lo, step), ids2, tile_fn(x[lo:lo + step], y), off


def _flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile off the diagonal with its transpose."""
    for batch in batches:
        yield batch
        off = batch.filter(pc.not_equal(batch.column("b"), batch.column("b2")))
        if off.num_rows:
            names = ["b2", "ids2", "flat2", "b", "ids1", "flat1"]
            yield pa.RecordBatch.from_arrays([off.column(c) for c in names], names=["b", "ids1", "flat1", "b2", "ids2", "flat2"])


def _best(ids1: pa.Array, ids2: pa.Array, k: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the `keep` largest values of each row among other ids, ties by id."""
    both = pa.concat_arrays([ids1, ids2]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    mine, theirs = both[:len(ids1), None], both[len(ids1):]
    own = (mine == theirs) & (mine >= 0)
    k = np.where(own, -np.inf, k)
    last = np.partition(k, -keep, axis=1)[:, -keep] if keep < k.shape[1] else np.full(len(k), -np.inf)
    rows, cols = np.nonzero((k >= last[:, None]) & ~own)
    place = np.empty(len(ids2), dtype=np.int64)
    place[pc.sort_indices(ids2).to_numpy()] = np.arange(len(ids2))
    order = np.lexsort((place[cols], -k[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
    return rows[first], cols[first]


def _pairs(a: DataFrame, b: DataFrame | None, key: str, col: str, tile_fn, block: int | None, out: tuple[str, str], value: str,
           keep: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """(left id, right id, value) of every pair; with `keep`, of each left id's largest values in every
    right block among other ids only.  Pairs leave a task a strip of a tile at a time."""
    id_type = dict(a.dtypes)[key]
    right_type = id_type if b is None else dict(b.dtypes)[key]
    mirror = b is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = mirror and keep is not None  # a row's largest values need whole rows
        for ids1, ids2, k, off in _strips(_flipped(batches) if flip else batches, tile_fn):
            if keep is not None:
                rows, cols = _best(ids1, ids2, k, keep)
                values = k[rows, cols]
            else:
                rows, cols = np.repeat(np.arange(len(ids1)), len(ids2)), np.tile(np.arange(len(ids2)), len(ids1))
                values = k.ravel()
            pairs = [ids1.take(pa.array(rows)), ids2.take(pa.array(cols))]
            yield pa.RecordBatch.from_arrays([*pairs, pa.array(values)], names=[*out, value])
            if mirror and off and not flip:
                yield pa.RecordBatch.from_arrays([*pairs[::-1], pa.array(values)], names=[*out, value])

    return _met(a, b, key, col, block, sized).mapInArrow(run, f"{out[0]} {id_type}, {out[1]} {right_type}, {value} double")


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def _sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(d, 0.0)


def pearson_pairs(vec: DataFrame, key: str = "g", col: str = "x", zero_std: str = "one",
                  block: int | None = None) -> DataFrame:
    """Pearson correlation of every two samples of one set."""
    z = standardised(vec, key, col, zero_std).where(F.col(col).isNotNull())
    pairs = _pairs(z, None, key, col, _dots, block, ("g1", "g2"), "k", sized=vec)
    if zero_std == "one":
        return pairs
    # A constant sample has no correlation: its pairs exist with a NULL value.
    ids = vec.select(key)
    flat = ids.join(z.select(key), key, "left_anti")
    return _with_null_pairs(pairs, ids, flat, key)


def pearson_top_k(vec: DataFrame, k: int, key: str = "g", col: str = "x", block: int | None = None) -> DataFrame:
    """For each sample the k others of highest Pearson correlation, ties by key: (g1, g2, k).
    A tile passes on k values per sample at most, so no list of all pairs is written."""
    from rankloom.operators.ordering import top_k
    pairs = _pairs(standardised(vec, key, col), None, key, col, _dots, block, ("g1", "g2"), "k", keep=k, sized=vec)
    return top_k(pairs, ["g1"], [F.col("k").desc(), F.col("g2").asc()], k, "__r").drop("__r")


def _with_null_pairs(pairs: DataFrame, ids: DataFrame, flat: DataFrame, key: str) -> DataFrame:
    from rankloom.operators.joins import expand_pairs
    none = F.lit(None).cast("double").alias("k")
    ids2 = ids.withColumnRenamed(key, "g2")
    rows = expand_pairs(flat.withColumnRenamed(key, "g1"), ids2, "g1", "g2").select("g1", "g2", none)
    live = ids.join(flat, key, "left_anti").withColumnRenamed(key, "g1")
    cols = expand_pairs(live, flat.withColumnRenamed(key, "g2"), "g1", "g2").select("g1", "g2", none)
    return pairs.unionByName(rows).unionByName(cols)


def pack_features(long: DataFrame, features: DataFrame, key: str = "g", feature: str = "f",
                  value: str = "x", position: str = "pos") -> DataFrame:
    """Long feature rows -> one vector per sample in list order, for the listed features."""
    rows = long.join(features.select(feature, position), feature)
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct(position, F.col(value).alias("v")))).alias("__s")).select(key, F.col("__s.v").alias("x"))


def pearson_cross(a: DataFrame, b: DataFrame, features: DataFrame, key: str = "g", feature: str = "f",
                  value: str = "x", position: str = "pos", block: int | None = None) -> DataFrame:
    """Pearson correlation of every sample of a with every sample of b over the listed
    features that both sets have."""
    common = (features.join(a.select(feature).distinct(), feature, "left_semi")
              .join(b.select(feature).distinct(), feature, "left_semi"))
    va = standardised(pack_features(a, common, key, feature, value, position), key)
    vb = standardised(pack_features(b, common, key, feature, value, position), key)
    return _pairs(va, vb, key, "x", _dots, block, ("g1", "g2"), "k")


def sq_dist_pairs(a: DataFrame, b: DataFrame | None = None, key: str = "g", col: str = "x",
                  block: int | None = None) -> DataFrame:
    """Squared Euclidean distance of every pair, a sample with itself included."""
    return _pairs(a, b, key, col, _sq, block, ("g1", "g2"), "d")


def rbf_pairs(a: DataFrame, b: DataFrame | None, gamma: float, key: str = "g", col: str = "x",
              block: int | None = None) -> DataFrame:
    """exp(-gamma * squared distance) of every pair."""
    fn = lambda x, y: np.exp(-gamma * _sq(x, y))
    return _pairs(a, b, key, col, fn, block, ("g1", "g2"), "k")


def _counts(p: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct leading bits and their counts."""
    n = np.bincount(p) if bits <= 20 else None
    if n is None:
        return np.unique(p, return_counts=True)
    there = np.flatnonzero(n)
    return there, n[there]


def median_gamma(vec: DataFrame, key: str = "g", col: str = "x", block: int | None = None,
                 levels: tuple[int, ...] = (20, 42, 64)) -> DataFrame:
    """1 / exact median of all squared distances, without shuffling or ranking the distances.

    The representation of non-negative doubles orders them.  Each pass counts the distances of the
    tiles by more of its leading bits, among those that share the bits found so far with the one or
    two middle distances; the last pass has all bits.  A pass returns a histogram of at most
    2^22 integers, whatever the number of pairs."""
    met = written(_met(vec, None, key, col, block))

    def counted(bits: int, before: int, kept: list[int]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            for _, _, k, off in _strips(batches, _sq):
                d = k.ravel().view(np.int64)
                if before:
                    d = d[np.isin(d >> (64 - before), kept)] if len(kept) > 1 else d[d >> (64 - before) == kept[0]]
                p, n = np.unique(d >> (64 - bits), return_counts=True) if before else _counts(d >> (64 - bits), bits)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n * (2 if off else 1), pa.int64())], names=["p", "n"])

        rows = met.mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
        table = rows.toArrow().sort_by("p")  # two numbers a bin, no object for any
        return table.column("p").to_numpy(), table.column("n").to_numpy()

    middle, before = [], 0  # (leading bits, rank among those that share them)
    for bits in levels:
        table = counted(bits, before, [p for p, _ in middle])
        if not before:
            total = int(table[1].sum())
            middle = [(0, (total + 1) // 2), (0, total // 2 + 1)] if total else []
        found = []
        for prefix, rank in middle:
            own = table[0] >> (bits - before) == prefix if before else np.ones(len(table[0]), dtype=bool)
            p, up = table[0][own], np.cumsum(table[1][own])
            at = int(np.searchsorted(up, rank))
            found.append((int(p[at]), rank - int(up[at - 1] if at else 0)))
        middle, before = found, bits
    low_high = np.array([p for p, _ in middle], dtype=np.int64).view(float).tolist()
    gamma = 2.0 / sum(low_high) if low_high and sum(low_high) > 0 else None
    return vec.sparkSession.createDataFrame([(gamma,)], "gamma double")
