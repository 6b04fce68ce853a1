"""Paths of (group, step): returns, advantages, sampled rankings and training-log scans.

Steps are dense 0-based integers.  All recursions run per (group, chunk of steps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.random import gumbel
from rankloom.operators.ordering import grouped_rank, hash_rank
from rankloom.operators.scans import CHUNK, discounted_suffix, next_value, prefix_scan


def discounted_returns(traj: DataFrame, gamma: float, by: list[str] = ["g"], step: str = "step",
                       reward: str = "reward", out: str = "q", chunk: int | None = None) -> DataFrame:
    """Reward to go."""
    return discounted_suffix(traj, by, step, {out: F.col(reward)}, gamma, chunk)


def centred_returns(traj: DataFrame, gamma: float, by: list[str] = ["g"], step: str = "step",
                    reward: str = "reward", out: str = "q_centred") -> DataFrame:
    q = discounted_returns(traj, gamma, by, step, reward, "__q")
    mean = q.groupBy(*by).agg(F.avg("__q").alias("__m"))
    return q.join(mean, by).withColumn(out, F.col("__q") - F.col("__m")).drop("__q", "__m")


def gae(traj: DataFrame, gamma: float, lam: float, by: list[str] = ["g"], step: str = "step",
        reward: str = "reward", value: str = "value", terminal: str = "delta",
        mask_last: bool = False, use_gae: bool = True, chunk: int | None = None) -> DataFrame:
    """Advantage and return per step.

    terminal="delta": the last step's delta is its reward and is carried back; return = A + v.
    terminal="reward": the last return is its reward and nothing is carried from it.
    mask_last: the end-of-path flag hides the last step from the one before it, and the last
    return is reward + value (reward alone without GAE)."""
    if terminal not in ("delta", "reward"):
        raise ValueError(f"unknown terminal {terminal!r}")
    ahead = next_value(traj, by, step, {"__v1": value, "__r1": reward}, chunk or CHUNK)
    if mask_last:
        ahead = next_value(ahead, by, step, {"__r2": "__r1"}, chunk or CHUNK)
    r, v, nxt = F.col(reward), F.col(value), F.col("__v1")
    last = F.col("__r1").isNull()
    if not use_gae:
        if not mask_last:
            out = discounted_suffix(ahead, by, step, {"__q": r}, gamma, chunk)
            return _finish(out, traj, F.col("__q") - v, F.col("__q"))
        # The last reward never reaches the step before it, so it is left out of the scan.
        out = discounted_suffix(ahead, by, step, {"__q": F.when(last, 0.0).otherwise(r)}, gamma, chunk)
        ret = F.when(last, r).otherwise(F.col("__q"))
        return _finish(out, traj, ret - v, ret)
    next_is_last = ~last & F.col("__r2").isNull() if mask_last else F.lit(False)
    delta = F.when(last, r).when(next_is_last, r - v).otherwise(r + F.lit(gamma) * nxt - v)
    ahead = ahead.withColumn("__d", delta)
    drop_tail = mask_last or terminal == "reward"
    fed = F.when(last, 0.0).otherwise(F.col("__d")) if drop_tail else F.col("__d")
    out = discounted_suffix(ahead, by, step, {"__a": fed}, gamma * lam, chunk)
    adv = F.when(last, F.col("__d")).otherwise(F.col("__a")) if drop_tail else F.col("__a")
    if terminal == "reward" and not mask_last:
        ret = F.when(last, r).otherwise(adv + v)
        return _finish(out, traj, F.when(last, r - v).otherwise(adv), ret)
    return _finish(out, traj, adv, adv + v)


def _finish(out: DataFrame, traj: DataFrame, advantage: Column, ret: Column) -> DataFrame:
    return out.select(*traj.columns, advantage.alias("advantage"), ret.alias("ret"))


def normalise_advantage(df: DataFrame, col: str = "advantage", eps: float = 1e-5) -> DataFrame:
    """(A - mean) / (sample std + eps) over the whole batch."""
    stats = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("sd")).alias("st")).scalar()
    return df.withColumn(col, (F.col(col) - stats["m"]) / (stats["sd"] + F.lit(eps)))


def sample_rankings(df: DataFrame, n: int = 1, seed=0, by: list[str] = ["g"], item: str = "i",
                    score: str = "s", label: str | None = "y") -> DataFrame:
    """n draws per group without replacement with odds exp(score): sorting by score plus
    Gumbel noise has the same distribution as drawing one item after the other."""
    rows = df.where(F.col(label).isNotNull()) if label else df
    drawn = (rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
             .withColumn("__key", F.col(score) + gumbel(seed, "draw", *by, item)))
    ranked = grouped_rank(drawn, [*by, "draw"], [F.col("__key").desc(), F.col(item).asc()], "step")
    return ranked.withColumn("step", F.col("step") - 1).drop("__key")


def _softmax_suffix(traj: DataFrame, by: list[str], step: str, score: str, parts: dict[str, Column],
                    chunk: int | None) -> DataFrame:
    """Suffix sums along the steps of expressions of the score and `__e`, exp(score - max)."""
    top = traj.groupBy(*by).agg(F.max(score).alias("__max"))
    rows = (traj.join(top, by).withColumn("__e", F.exp(F.col(score) - F.col("__max"))))
    return discounted_suffix(rows, by, step, parts, 1.0, chunk)


def ranking_log_prob(traj: DataFrame, by: list[str] = ["g"], step: str = "step", score: str = "s",
                     out: str = "log_prob", chunk: int | None = None) -> DataFrame:
    """Log-probability of each pick given the items picked before it."""
    sums = _softmax_suffix(traj, by, step, score, {"__z": F.col("__e")}, chunk)
    return sums.select(*traj.columns, (F.col(score) - F.col("__max") - F.log("__z")).alias(out))


def entropy_stat(traj: DataFrame, kind: str = "ref", by: list[str] = ["g"], step: str = "step",
                 score: str = "s", chunk: int | None = None) -> DataFrame:
    """Mean per step over the groups still picking: -sum(p * score) over the remaining items
    ("ref"), or the Shannon entropy -sum(p * ln p)."""
    if kind not in ("ref", "shannon"):
        raise ValueError(f"unknown kind {kind!r}")
    sums = _softmax_suffix(traj, by, step, score,
                           {"__z": F.col("__e"), "__zs": F.col("__e") * F.col(score)}, chunk)
    expected = F.col("__zs") / F.col("__z")
    stat = -expected if kind == "ref" else F.col("__max") + F.log("__z") - expected
    return sums.groupBy(step).agg(F.avg(stat).alias("entropy"))


def remaining(traj: DataFrame, by: list[str] = ["g"], step: str = "step") -> DataFrame:
    """The candidate mask as intervals: the item picked at `step` can still be chosen at
    every step from 0 through its own, and `candidates` items are left when it is."""
    sizes = traj.groupBy(*by).agg(F.count("*").alias("__n"))
    return (traj.join(sizes, by)
            .select(*traj.columns, F.lit(0).alias("open_from"), F.col(step).alias("open_until"),
                    (F.col("__n") - F.col(step)).alias("candidates")))


def segments(traj: DataFrame, by: list[str] = ["g"], step: str = "step") -> DataFrame:
    sizes = traj.groupBy(*by).agg(F.count("*").alias("length"))
    return (traj.join(sizes, by)
            .select(*traj.columns, "length", (F.col(step) == F.col("length") - 1).alias("is_last")))


def surrogate_stats(old: DataFrame, new: DataFrame, eps: float, c1: float, c2: float,
                    on: list[str] = ["g", "step"]) -> DataFrame:
    """Diagnostics of a clipped policy update.  `old` holds log_prob, value, ret and
    advantage; `new` holds log_prob, value and entropy."""
    o = old.select(*on, F.col("log_prob").alias("lp0"), F.col("value").alias("v0"), "ret", "advantage")
    n = new.select(*on, F.col("log_prob").alias("lp1"), F.col("value").alias("v1"), "entropy")
    ratio = F.exp(F.col("lp1") - F.col("lp0"))
    adv, ret = F.col("advantage"), F.col("ret")
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    kept = F.col("v0") + clip(F.col("v1") - F.col("v0"), -eps, eps)
    sq = lambda c: (c - ret) * (c - ret)
    rows = o.join(n, on).select(
        ratio.alias("ratio"),
        F.least(ratio * adv, clip(ratio, 1.0 - eps, 1.0 + eps) * adv).alias("gain"),
        (F.lit(0.5) * F.greatest(sq(F.col("v1")), sq(kept))).alias("vloss"),
        "entropy",
        ((ratio < 1.0 - eps) | (ratio > 1.0 + eps)).alias("clipped"))
    sums = rows.agg(
        F.avg("ratio").alias("mean_ratio"), (-F.avg("gain")).alias("action_loss"),
        F.avg("vloss").alias("value_loss"), F.avg("entropy").alias("entropy"),
        F.avg(F.col("clipped").cast("double")).alias("clip_share"))
    total = F.col("action_loss") + F.lit(c1) * F.col("value_loss") - F.lit(c2) * F.col("entropy")
    return sums.withColumn("total_loss", total)


def minibatches(traj: DataFrame, n: int, key: str, seed=0) -> DataFrame:
    """Shuffled batches of floor(rows / n) rows; rows past the last whole batch are left out,
    as they are in one training pass."""
    ranked = hash_rank(traj, key, seed, "__rn", "__n")
    size = F.floor(F.col("__n") / n)
    batch = F.floor((F.col("__rn") - 1) / size)
    return (ranked.withColumn("batch", batch)
            .where((F.col("batch") + 1) * size <= F.col("__n"))
            .drop("__rn", "__n"))


def early_stop(log: DataFrame, patience: int, epoch: str = "epoch", metric: str = "test_ndcg",
               by: list[str] = [], chunk: int = CHUNK) -> DataFrame:
    """Epochs up to the one where `patience` epochs in a row brought no new best, with the
    best so far and the number of epochs since it."""
    cols = log.columns
    seen = prefix_scan(log, by, epoch, {"__prev": ("max", F.col(metric))}, exclusive=True, chunk=chunk)
    better = F.coalesce(F.col(metric) > F.col("__prev"), F.col(metric).isNotNull())
    marked = (seen.withColumn("best", F.greatest(metric, "__prev")).withColumn("is_best", better)
              .withColumn("__at", F.when(better, F.col(epoch))))
    start = log.groupBy(*by).agg(F.min(epoch).alias("__start")) if by else None
    run = prefix_scan(marked, by, epoch, {"__since": ("max", F.col("__at"))}, chunk=chunk)
    if by:
        run = run.join(start, by)
    else:
        run = run.withColumn("__start", log.agg(F.min(epoch)).scalar())
    waited = F.col(epoch) - F.coalesce(F.col("__since"), F.col("__start") - 1)
    run = run.withColumn("waited", waited)
    if patience <= 0:
        return run.select(*cols, "best", "is_best", "waited")
    run = prefix_scan(run.withColumn("__hit", (F.col("waited") >= patience).cast("long")), by, epoch,
                      {"__hits": ("sum", F.col("__hit"))}, exclusive=True, chunk=chunk)
    return run.where(F.coalesce(F.col("__hits"), F.lit(0)) == 0).select(*cols, "best", "is_best", "waited")


def running_average(df: DataFrame, value: str, weight: str, step: str, by: list[str] = [],
                    out: str = "avg", chunk: int = CHUNK) -> DataFrame:
    """Weighted mean of everything up to and including each step."""
    run = prefix_scan(df, by, step, {"__s": ("sum", F.col(value) * F.col(weight)),
                                     "__w": ("sum", F.col(weight))}, chunk=chunk)
    return run.select(*df.columns, (F.col("__s") / F.col("__w")).alias(out))
