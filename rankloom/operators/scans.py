"""Ordered scans along integer steps, cut into chunks.

A chunk is a fixed range of steps, so (group, chunk) spreads one long group over many
tasks.  Each chunk is scanned on its own and then receives one carried value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.runtime import join_groups

CHUNK = 65_536


def _chunked(df: DataFrame, step: str, size: int) -> DataFrame:
    return (df.withColumn("__chunk", F.floor(F.col(step) / size))
            .withColumn("__off", F.col(step) - F.col("__chunk") * size))


def chunk_for(gamma: float) -> int:
    """Steps after which gamma has decayed to about 1e-100, within sane bounds."""
    if gamma <= 0.0 or gamma >= 1.0:
        return CHUNK
    return max(64, min(CHUNK, int(100.0 / -math.log10(gamma))))


def discounted_suffix(df: DataFrame, by: list[str], step: str, values: dict[str, Column],
                      gamma: float, chunk: int | None = None) -> DataFrame:
    """out_t = value_t + gamma * out_{t+1} within each group, for every (out, value)."""
    if not 0.0 <= gamma <= 1.0:
        raise ValueError("gamma must be in [0, 1]")
    cols = df.columns
    if gamma == 0.0:
        return df.select(*cols, *[v.alias(o) for o, v in values.items()])
    size = chunk or chunk_for(gamma)
    outs = list(values)
    base = df.select("*", *[v.cast("double").alias(f"__v_{o}") for o, v in values.items()])
    base = _chunked(base, step, size)
    weight = F.pow(F.lit(float(gamma)), F.col("__off"))
    tail = (Window.partitionBy(*by, "__chunk").orderBy(F.col(step).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = base.select(
        *cols, "__chunk", "__off",
        *[(F.sum(F.col(f"__v_{o}") * weight).over(tail) / weight).alias(f"__l_{o}") for o in outs])
    heads = base.groupBy(*by, "__chunk").agg(
        *[F.sum(F.col(f"__v_{o}") * weight).alias(f"__h_{o}") for o in outs])
    carry = _carry(heads, by, outs, float(gamma) ** size)
    reach = F.pow(F.lit(float(gamma)), F.lit(size) - F.col("__off"))
    return (join_groups(local, carry, [*by, "__chunk"], "left")
            .select(*cols, *[(F.col(f"__l_{o}") + reach * F.coalesce(F.col(f"__c_{o}"), F.lit(0.0)))
                             .alias(o) for o in outs]))


def _carry(heads: DataFrame, by: list[str], outs: list[str], decay: float) -> DataFrame:
    """Return at the start of the next chunk, keyed by the chunk that receives it."""
    if decay <= 1e-60:
        # Terms five chunks away are scaled by 1e-240 or less: below the last bit.
        sent = heads.select(*by, "__chunk", *[f"__h_{o}" for o in outs],
                            F.explode(F.sequence(F.lit(1), F.lit(4))).alias("__d"))
        fade = F.pow(F.lit(decay), F.col("__d") - 1)
        return (sent.withColumn("__chunk", F.col("__chunk") - F.col("__d"))
                .where(F.col("__chunk") >= 0)
                .groupBy(*by, "__chunk")
                .agg(*[F.sum(F.col(f"__h_{o}") * fade).alias(f"__c_{o}") for o in outs]))
    if decay == 1.0:
        after = (Window.partitionBy(*by).orderBy(F.col("__chunk").desc())
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        full = heads.select(*by, "__chunk", *[F.sum(f"__h_{o}").over(after).alias(f"__c_{o}") for o in outs])
    else:
        # The chunks form a shorter path with a stronger decay.
        path = heads.withColumnRenamed("__chunk", "__at")
        full = discounted_suffix(path, by, "__at", {f"__c_{o}": F.col(f"__h_{o}") for o in outs}, decay)
        full = full.drop(*[f"__h_{o}" for o in outs]).withColumnRenamed("__at", "__chunk")
    return full.withColumn("__chunk", F.col("__chunk") - 1)


_COMBINE = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def prefix_scan(df: DataFrame, by: list[str], step: str, exprs: dict[str, tuple[str, Column]],
                exclusive: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Running sum, max or min along the steps; `exclusive` leaves the current row out."""
    cols = df.columns
    base = _chunked(df.select("*", *[v.alias(f"__v_{o}") for o, (_, v) in exprs.items()]), step, chunk)
    last = -1 if exclusive else Window.currentRow
    run = Window.partitionBy(*by, "__chunk").orderBy(step).rowsBetween(Window.unboundedPreceding, last)
    local = base.select(*cols, "__chunk", *[
        _COMBINE[kind][0](f"__v_{o}").over(run).alias(f"__l_{o}") for o, (kind, _) in exprs.items()])
    line = Window.partitionBy(*by).orderBy("__chunk") if by else \
        Window.partitionBy(F.lit(0)).orderBy("__chunk")
    line = line.rowsBetween(Window.unboundedPreceding, -1)
    heads = base.groupBy(*by, "__chunk").agg(*[
        _COMBINE[kind][0](f"__v_{o}").alias(f"__h_{o}") for o, (kind, _) in exprs.items()])
    carry = heads.select(*by, "__chunk", *[
        _COMBINE[kind][0](f"__h_{o}").over(line).alias(f"__c_{o}") for o, (kind, _) in exprs.items()])

    def joined(out: str, kind: str) -> Column:
        here, prior = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        return F.coalesce(_COMBINE[kind][1](here, prior), here, prior).alias(out)

    return (join_groups(local, carry, [*by, "__chunk"])
            .select(*cols, *[joined(o, kind) for o, (kind, _) in exprs.items()]))


def next_value(df: DataFrame, by: list[str], step: str, values: dict[str, str],
               chunk: int = CHUNK) -> DataFrame:
    """Value of the following step, NULL at the end of the group."""
    cols = df.columns
    base = _chunked(df, step, chunk)
    line = Window.partitionBy(*by, "__chunk").orderBy(step)
    local = base.select(*cols, "__chunk",
                        F.lead(F.lit(1)).over(line).alias("__more"),
                        *[F.lead(v).over(line).alias(f"__n_{o}") for o, v in values.items()])
    firsts = (base.groupBy(*by, "__chunk")
              .agg(*[F.min_by(v, step).alias(f"__f_{o}") for o, v in values.items()])
              .withColumn("__chunk", F.col("__chunk") - 1))
    return (join_groups(local, firsts, [*by, "__chunk"], "left")
            .select(*cols, *[F.when(F.col("__more") == 1, F.col(f"__n_{o}"))
                             .otherwise(F.col(f"__f_{o}")).alias(o) for o in values]))


def add_steps(df: DataFrame, by: list[str], order: list[Column], out: str = "step") -> DataFrame:
    """Dense 0-based step numbers from any order."""
    from rankloom.operators.ordering import grouped_rank
    return grouped_rank(df, by, order, out).withColumn(out, F.col(out) - 1)
