"""Named queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


class Tables:
    """Lazy readers for the tables of one scale folder: `t.lineitem`, `t.events`, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}

INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def settled(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, doubles to six decimals; the shift keeps half-way cases, which
    differ in the last bit between engines, on one side."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in INTEGERS:
            c = c.cast("bigint")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double") + F.lit(1e-9), 6)
        cols.append(c.alias(name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, dbl: str = "", num: str = ""):
    """Register a builder.  `dbl` and `num` list the columns of the SQL to settle."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        text = sql
        if sql is not None:
            fixes = [f"round(CAST({c} AS DOUBLE) + 1e-9, 6) AS {c}" for c in dbl.split()]
            fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in num.split()]
            if fixes:
                text = f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({sql}) AS settled"
        ENTRIES[name] = Entry(build, text)
        return build

    return add
