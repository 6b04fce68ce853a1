"""Randomness as a function of (seed, key): the same row always draws the same number,
whatever the partitioning, retries or engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_hash(seed, *keys) -> Column:
    """128-bit digest as 32 hex characters; its lexical order is a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def uniform(seed, *keys) -> Column:
    """Uniform draw strictly inside (0, 1) from the first 32 bits of the digest."""
    bits = F.conv(F.substring(key_hash(seed, *keys), 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def gumbel(seed, *keys) -> Column:
    return -F.log(-F.log(uniform(seed, *keys)))


def normal(seed, *keys) -> Column:
    """Standard normal by the Box-Muller transform of two keyed draws."""
    u1, u2 = uniform(f"{seed}a", *keys), uniform(f"{seed}b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
