"""Scalar expressions; each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def name_key(c) -> Column:
    """Lower-case, drop every leading and trailing x, then the outer blanks."""
    return F.trim(F.btrim(F.lower(_col(c)), F.lit("x")))


def patient_id(c) -> Column:
    return F.substring(F.replace(F.upper(_col(c)), F.lit("."), F.lit("-")), 1, 12)


def short_name(c) -> Column:
    return F.lower(F.split_part(_col(c), F.lit("_"), F.lit(1)))


def symbol(c) -> Column:
    return F.split_part(_col(c), F.lit("|"), F.lit(1))


def norm_text(c) -> Column:
    return F.trim(F.lower(_col(c)))


def log2p1(c) -> Column:
    return F.log2(_col(c) + F.lit(1.0))


def auto_log2(df: DataFrame, col: str, cutoff: float = 100.0) -> DataFrame:
    """log2(x + 1) on the whole column when its global maximum shows a linear scale."""
    top = df.agg(F.max(col)).scalar()
    return df.withColumn(col, F.when(top > cutoff, log2p1(col)).otherwise(F.col(col)))


def ic50_sensitivity(c) -> Column:
    """1 / (1 + exp(x) ** -0.1), folded into one exponential."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_col(c) * F.lit(-0.1)))


def ic50_linear(c) -> Column:
    return F.exp(_col(c))


def is_number(c) -> Column:
    return _col(c).try_cast("double").isNotNull()


def smiles_tokens(c) -> Column:
    """One token per character, joined with a lower-case character right after it; a lone
    lower-case character at the very end is not a token."""
    raw = F.regexp_extract_all(_col(c), F.lit("(.[a-z]|.)"), F.lit(1))
    lone = F.regexp_like(F.element_at(raw, -1), F.lit("^[a-z]$"))
    return F.when(F.size(raw) == 0, raw).when(lone, F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)


def cm_to_inch(c) -> Column:
    return _col(c) / F.lit(2.54)


def linear_decay(lr0: float, epoch, epochs) -> Column:
    return F.lit(float(lr0)) * (F.lit(1.0) - _col(epoch) / _col(epochs))


def gain(label) -> Column:
    """2^y - 1."""
    return F.pow(F.lit(2.0), _col(label)) - F.lit(1.0)
