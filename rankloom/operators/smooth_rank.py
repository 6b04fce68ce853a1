"""Approximate NDCG: ranks replaced with sums of sigmoids over all other items of a group.

The pair sum f(s_a) = sum_b sigmoid(alpha (s_b - s_a)) never lists pairs.  The score axis is
cut into cells of width 1 / alpha.  Within a cell the sigmoid is a polynomial to machine
precision, so a cell's rows act on others only through DEGREE Chebyshev moments, and f inside
a cell is again such a polynomial.  Rows are summed into cells, cells meet their neighbours,
and cells further away contribute the constants 1 (above) or `eps` (below).  Approximate NDCG does
so within a task for groups that fit one, after one shuffle of their rows."""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankloom import runtime
from rankloom.functions.scalars import gain
from rankloom.operators.ordering import grouped_rank
from rankloom.operators.scans import prefix_scan
from rankloom.runtime import hot_groups, shuffle_partitions, written

DEGREE = 14
TILE = 256
# Rows of a group that is computed whole in a task.
TASK_ROWS = 200_000


def _chebyshev(u: Column, m: int) -> Column:
    return F.cos(F.lit(float(m)) * F.acos(F.least(F.greatest(2.0 * u - 1.0, F.lit(-1.0)), F.lit(1.0))))


def _transfers(eps: float) -> dict[int, np.ndarray]:
    """Moments of a source cell -> Chebyshev coefficients of its pair sum in a target cell,
    for every distance (source - target) at which the sum is not constant."""
    p = DEGREE
    theta = (np.arange(p) + 0.5) * np.pi / p
    nodes = (np.cos(theta) + 1.0) / 2.0
    to_coef = 2.0 / p * np.cos(np.outer(np.arange(p), theta))
    to_coef[0] /= 2.0
    low, high = int(np.ceil(-np.log(eps))) + 1, 38
    out = {}
    for d in range(-low, high + 1):
        gap = d + nodes[None, :] - nodes[:, None]
        out[d] = to_coef @ np.maximum(1.0 / (1.0 + np.exp(-gap)), eps) @ to_coef.T
    return out


def _meet_cells(by: list[str], transfers: dict[int, np.ndarray]):
    """Task body: rows sorted by (group, tile, cell); each tile holds its own cells and those
    of its neighbours within reach, at most two tiles' worth."""
    p = DEGREE
    span = 4 * TILE

    def complete(part: pd.DataFrame) -> pd.DataFrame:
        edge = np.zeros(len(part), dtype=bool)
        for c in [*by, "tile"]:
            v = part[c].to_numpy()
            edge[1:] |= v[1:] != v[:-1]
        cell, tile = part["cell"].to_numpy(), part["tile"].to_numpy()
        key = np.cumsum(edge) * span + (cell - tile * TILE + TILE)
        moments = part[[f"m{j}" for j in range(p)]].to_numpy()
        own = np.flatnonzero(cell // TILE == tile)
        coef = np.zeros((len(own), p))
        above, below = np.zeros(len(own)), np.zeros(len(own))
        for shift, matrix in transfers.items():
            want = key[own] + shift
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero(key[at] == want)
            source = moments[at[hit]]
            coef[hit] += source @ matrix.T
            if shift > 0:
                above[hit] += source[:, 0]
            elif shift < 0:
                below[hit] += source[:, 0]
        out = {c: part[c].to_numpy()[own] for c in [*by, "cell"]}
        out.update(up=above, dn=below)
        out.update({f"c{j}": coef[:, j] for j in range(p)})
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            part = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = part.iloc[-1]
            same = np.ones(len(part), dtype=bool)
            for c in [*by, "tile"]:
                same &= (part[c] == last[c]).to_numpy()
            cut = len(part) - int(same[::-1].cumprod().sum())
            held = part.iloc[cut:]
            if cut:
                yield complete(part.iloc[:cut])
        if held is not None:
            yield complete(held)

    return run


def smooth_positions(df: DataFrame, alpha: float = 10.0, eps: float = 1e-9, by: list[str] = ["g"],
                     score: str = "s", out: str = "pos") -> DataFrame:
    """1 + sum over the other rows b of max(sigmoid(alpha (s_b - s_a)), eps)."""
    p = DEGREE
    cols = df.columns
    scaled = F.col(score) * F.lit(float(alpha))
    rows = (df.withColumn("__t", scaled).withColumn("cell", F.floor("__t"))
            .withColumn("__u", F.col("__t") - F.col("cell")).drop("__t"))
    cells = rows.groupBy(*by, "cell").agg(*[F.sum(_chebyshev(F.col("__u"), j)).alias(f"m{j}") for j in range(p)])
    types = dict(df.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in by] + ["cell long", "up double", "dn double"]
                       + [f"c{j} double" for j in range(p)])
    transfers = _transfers(eps)
    reach = F.sequence(F.floor((F.col("cell") - max(transfers)) / TILE), F.floor((F.col("cell") - min(transfers)) / TILE))
    tiles = (cells.withColumn("tile", F.explode(reach)).repartition(shuffle_partitions(df), *by, "tile")
             .sortWithinPartitions(*by, "tile", "cell"))
    near = tiles.mapInPandas(_meet_cells(by, transfers), schema)
    counts = cells.select(*by, "cell", F.col("m0").alias("__n"))
    lower = prefix_scan(counts, by, "cell", {"__cum": ("sum", F.col("__n"))})
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    field = (lower.join(near, [*by, "cell"]).join(total, by)
             .withColumn("__far", (F.col("__all") - F.col("__cum") - F.col("up"))
                         + F.lit(eps) * (F.col("__cum") - F.col("__n") - F.col("dn"))))
    inside = sum((F.col(f"c{j}") * _chebyshev(F.col("__u"), j) for j in range(p)), F.lit(0.0))
    # The sum includes the row itself, whose own term is sigmoid(0) = 1/2.
    return (rows.join(field, [*by, "cell"])
            .select(*cols, (F.lit(0.5) + inside + F.col("__far")).alias(out)))


def _whole_groups(by: list[str], label: str, score: str, alpha: float, eps: float, out: str):
    """Task body: rows sorted by group, none of them too large for a task; the cells, moments and sums of
    `smooth_positions`, and the DCG over the ideal one, where the rows are."""
    transfers = _transfers(eps)
    gap = 1.0 + max(max(transfers), -min(transfers))
    degrees = np.arange(DEGREE)

    def edges(part: pd.DataFrame) -> np.ndarray:
        edge = np.zeros(len(part), dtype=bool)
        edge[0] = True
        for c in by:
            v = part[c].to_numpy()
            edge[1:] |= v[1:] != v[:-1]
        return edge

    def complete(part: pd.DataFrame) -> pd.DataFrame:
        edge = edges(part)
        group, starts = np.cumsum(edge) - 1, np.flatnonzero(edge)
        t = part[score].to_numpy(dtype=float) * alpha
        cell = np.nan_to_num(np.floor(t), nan=0.0, posinf=2.0 ** 63, neginf=-2.0 ** 63)
        order = np.lexsort((cell, group))
        u, cell, of = (t - cell)[order], cell[order], group[order]
        shape = np.cos(np.arccos(np.clip(np.nan_to_num(2.0 * u - 1.0, nan=1.0), -1.0, 1.0))[:, None] * degrees)
        first = np.r_[True, (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])]
        at, spot = np.flatnonzero(first), np.cumsum(first) - 1
        moments, own = np.add.reduceat(shape, at, axis=0), of[at]
        # cells as places on one line: distances within reach are kept, longer ones and other groups are out of reach
        place = np.cumsum(np.r_[0.0, np.where(own[1:] != own[:-1], gap, np.minimum(np.diff(cell[at]), gap))])
        coef, above, below = np.zeros_like(moments), np.zeros(len(at)), np.zeros(len(at))
        for shift, matrix in transfers.items():
            want = place + shift
            there = np.minimum(np.searchsorted(place, want), len(place) - 1)
            hit = np.flatnonzero(place[there] == want)
            source = moments[there[hit]]
            coef[hit] += source @ matrix.T
            if shift:
                (above if shift > 0 else below)[hit] += source[:, 0]
        upto, count = np.cumsum(moments[:, 0]), np.bincount(own, weights=moments[:, 0])
        upto -= (np.cumsum(count) - count)[own]
        far = (count[own] - upto - above) + eps * (upto - moments[:, 0] - below)
        place_of = 0.5 + (coef[spot] * shape).sum(1) + far[spot]
        y = part[label].to_numpy(dtype=float)
        got = np.bincount(of, weights=(np.exp2(y[order]) - 1.0) / np.log2(1.0 + place_of))
        best = np.lexsort((-y, group))
        ideal = np.bincount(group, weights=(np.exp2(y[best]) - 1.0) / np.log2(np.arange(len(y)) - starts[group] + 2.0))
        found = {c: part[c].to_numpy()[starts] for c in by}
        return pd.DataFrame({**found, out: got / np.maximum(ideal, eps)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            cut = np.flatnonzero(edges(pdf))[-1]
            if not cut and len(held) > 1 and all((held[-2][c].iloc[-1] == pdf[c].iloc[0]) for c in by):
                continue  # one group goes on
            whole = pd.concat([*held[:-1], pdf.iloc[:cut]], ignore_index=True)
            held = [pdf.iloc[cut:]]
            if len(whole):
                yield complete(whole)
        if held:
            yield complete(pd.concat(held, ignore_index=True))

    return run


def approx_ndcg(df: DataFrame, alpha: float = 10.0, eps: float = 1e-9, by: list[str] = ["g"],
                item: str = "i", label: str = "y", score: str = "s", out: str = "approx_ndcg") -> DataFrame:
    """Approximate NDCG per group over observed labels, negative labels counting as 0.

    Groups of up to TASK_ROWS rows are computed whole in a task; larger ones by cells."""
    real = reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.col(label).isNotNull() & F.col(score).isNotNull())
    # counted and read again, but computed once
    seen = written(df.where(real).select(*by, F.greatest(F.col(label), F.lit(0.0)).cast("double").alias(label), F.col(score).cast("double").alias(score)))
    hot = hot_groups(seen, by, min(TASK_ROWS, runtime.HOT_GROUP_ROWS))
    cold = seen if hot is None else seen.join(hot, by, "left_anti").select(*seen.columns)
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], f"`{out}` double"])
    rows = cold.repartition(shuffle_partitions(seen), *by).sortWithinPartitions(*by)
    whole = rows.mapInPandas(_whole_groups(by, label, score, float(alpha), eps, out), schema)
    if hot is None:
        return whole
    large = seen.join(hot, by, "left_semi").select(*seen.columns)
    # equal labels have equal gains, so their order doesn't matter
    ideal = (grouped_rank(large, by, [F.col(label).desc()], "__r")
             .groupBy(*by).agg(F.sum(gain(label) / F.log2(F.col("__r") + F.lit(1.0))).alias("__i")))
    placed = smooth_positions(large, alpha, eps, by, score, "__pos")
    got = placed.groupBy(*by).agg(F.sum(gain(label) / F.log2(F.lit(1.0) + F.col("__pos"))).alias("__d"))
    return whole.unionByName(got.join(ideal, by).select(*by, (F.col("__d") / F.greatest("__i", F.lit(eps))).alias(out)))


def approx_ndcg_loss(df: DataFrame, **options) -> DataFrame:
    return approx_ndcg(df, **options).agg((-F.avg("approx_ndcg")).alias("loss"))
