"""Readers: every layout becomes a long, keyed table with NULL for missing values."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.scalars import nan_to_null
from rankloom.operators.ordering import grouped_rank, top_k
from rankloom.runtime import shuffle_partitions

MISSING = "NA"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and \
        len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def _table(spark: SparkSession, path: str, sep: str = ",", missing: str = MISSING) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, nullValue=missing)


def _long(df: DataFrame, key: str, names: list[str], row: str, col: str, value: str, kind: str) -> DataFrame:
    """Unpivot the named columns, dropping missing cells."""
    cells = df.select(F.col(f"`{key}`").alias(row), F.explode(F.array(*[
        F.struct(F.lit(n).alias(col), F.col(f"`{n}`").try_cast(kind).alias(value)) for n in names])).alias("c"))
    out = cells.select(row, f"c.{col}", f"c.{value}")
    if kind == "double":
        out = out.withColumn(value, nan_to_null(value))
    return out.where(F.col(value).isNotNull())


def read_matrix(spark: SparkSession, path: str, row: str = "g", col: str = "i", value: str = "y",
                sep: str = ",", missing: str = MISSING) -> DataFrame:
    """Wide matrix with the row key in its first column."""
    df = _table(spark, path, sep, missing)
    key, *names = df.columns
    return _long(df, key, names, row, col, value, "double")


def read_expression(spark: SparkSession, path: str, symbol: str = "GENE_SYMBOLS",
                    annotations: tuple[str, ...] = ("GENE_title",), prefix: str = "DATA.") -> DataFrame:
    """Features in rows, samples in columns named prefix + id -> (g, f, x)."""
    df = _table(spark, path, "\t").drop(*annotations)
    names = [c for c in df.columns if c != symbol]
    long = _long(df, symbol, names, "f", "g", "x", "double")
    return long.select(F.expr(f"substring(g, {len(prefix) + 1})").alias("g"), "f", "x").where("f is not null")


def read_events(spark: SparkSession, path: str, orient: str, sep: str = "\t",
                required: bool = False) -> DataFrame:
    """0/1 matrix with features ("rows") or samples ("columns") down the side -> (g, f, x INT).
    A missing optional file gives an empty table."""
    if orient not in ("rows", "columns"):
        raise ValueError(f"unknown orientation {orient!r}")
    if not _exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        warnings.warn(f"{path} is absent: this modality is skipped")
        return spark.createDataFrame([], "g string, f string, x int")
    df = _table(spark, path, sep)
    key, *names = df.columns
    row, col = ("f", "g") if orient == "rows" else ("g", "f")
    return _long(df, key, names, row, col, "x", "int").select("g", "f", "x")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): text lines with their place, in file order by (block, at)."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def _first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines of every file with 1-based numbers; n rows per file leave the scan."""
    return top_k(lines, ["file"], [F.col("block").asc(), F.col("at").asc()], n, "line")


def _after(lines: DataFrame, n: int) -> DataFrame:
    """Every file without its first n lines."""
    if n <= 0:
        return lines
    cut = _first_lines(lines, n).groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    return (lines.join(cut, "file").where(F.struct("block", "at") > F.col("last")).drop("last"))


def _numbered(lines: DataFrame) -> DataFrame:
    """All lines with 1-based numbers per file."""
    return grouped_rank(lines, ["file"], [F.col("block").asc(), F.col("at").asc()], "line")


def _cells(line, width: int, sep: str):
    """The cells of a line as an array, by the rules of CSV (quotes, escapes); missing ones are NULL."""
    row = F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), {"sep": sep, "mode": "PERMISSIVE"})
    return F.array(*[row[f"c{i}"] for i in range(width)])


def _width(lines: DataFrame, sep: str) -> int:
    """The most cells that any of the lines has; separators inside quoted cells are none."""
    mark = re.escape(sep)
    bare = F.regexp_replace("value", rf'(^|{mark})"(?:[^"\\]|\\.)*+"', "$1")
    return lines.agg(F.max(F.size(F.split(bare, mark)))).first()[0] or 1


def read_region(spark: SparkSession, path: str, id_row: int = 5, name_row: int = 6, first_row: int = 7,
                key_cols: int = 2, sep: str = ",") -> DataFrame:
    """Rectangular sheet region: item ids and names in two header lines, group id and name in
    the first columns, values in the body -> (g, g_name, i, i_name, y)."""
    lines = _lines(spark, path)
    top = _first_lines(lines, max(id_row, name_row))
    width = _width(top, sep)
    cells = lambda: F.transform(_cells(F.col("value"), width, sep), lambda c: F.coalesce(c, F.lit("")))

    def header(line: int, out: str) -> DataFrame:
        return top.where(F.col("line") == line).select(
            "file", F.posexplode(cells()).alias("pos", out))

    heads = (header(id_row, "i").join(header(name_row, "i_name"), ["file", "pos"])
             .where(F.col("pos") >= key_cols))
    body = (_after(lines, first_row - 1).where("value <> ''")
            .select("file", cells().alias("v"))
            .select("file", F.col("v")[0].alias("g"), F.col("v")[key_cols - 1].alias("g_name"),
                    F.posexplode("v").alias("pos", "cell")))
    value = F.when(F.col("cell") != MISSING, F.col("cell").try_cast("double"))
    return (body.join(heads, ["file", "pos"]).withColumn("y", nan_to_null(value))
            .where("y is not null").select("g", "g_name", "i", "i_name", "y"))


def read_thresholds(spark: SparkSession, thresholds: str, items: str, sep: str = ",") -> DataFrame:
    """A line of thresholds and a column of item ids, paired by position."""
    line = _first_lines(_lines(spark, thresholds), 1)
    thr = line.select(F.posexplode(_cells(F.col("value"), _width(line, sep), sep)).alias("pos", "thr"))
    ids = (_numbered(_lines(spark, items).where("value <> ''"))
           .select((F.col("line") - 1).alias("pos"), F.trim(_cells(F.col("value"), 1, sep)[0]).alias("i")))
    return ids.join(thr, "pos").select("i", F.col("thr").try_cast("double").alias("thr"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One key per line, no header."""
    return spark.read.csv(path, schema="key string", header=False).where("key is not null")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", comment: str = "#",
                   skip_rows: int = 0, skip_cols: int = 0, names: list[str] | None = None) -> DataFrame:
    """Delimited text, gzip or plain, without `#` lines, the first rows or the first columns.
    Without `names` the longest row decides the number of columns, found by one pass; shorter rows
    end with NULLs.  A record is a line, blank ones are none; quoted line breaks end it.
    A gzip file cannot be split, so its rows are spread after reading."""
    lines = _lines(spark, path).where(~F.col("value").startswith(comment))
    if skip_rows == 0 and names:
        raw = spark.read.csv(path, sep=sep, comment=comment, header=False)
        cells = raw.select(*raw.columns[skip_cols:])
    else:
        kept = _after(lines, skip_rows)
        width = len(names) + skip_cols if names else max(_width(kept, sep), skip_cols + 1)
        parts = _cells(F.col("value"), width, sep)
        cells = kept.where("value <> ''").select(*[parts[i].alias(f"_c{i}") for i in range(skip_cols, width)])
    if path.endswith(".gz"):
        cells = cells.repartition(shuffle_partitions(cells))
    return cells.toDF(*names) if names else cells


def read_map(spark: SparkSession, path: str, key: str = "id", value: str = "smiles") -> DataFrame:
    return (spark.read.csv(path, sep="\t", schema=f"{key} string, {value} string")
            .select(F.trim(key).alias(key), F.trim(value).alias(value)))


def resolve(spark: SparkSession, path: str, patterns: list[str]) -> str | None:
    """First file, by pattern order then by path, matching any pattern below the folder."""
    for pattern in patterns:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                 .option("recursiveFileLookup", "true").load(path).agg(F.min("path")).first()[0])
        if found is not None:
            return found
    return None


def load_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


EPOCH_LOG = "epoch int, train_ndcg double, train_rewards double, test_ndcg double, test_rewards double"


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=EPOCH_LOG)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions; filters on the run columns only open matching folders."""
    return spark.read.parquet(path)


def read_fold(spark: SparkSession, features: str, response: str, folds: str, fold: int,
              inner: int | None = None) -> dict[str, DataFrame]:
    """Train and test sides of a fold from the stored tables.  With `inner`, the fold table's
    inner splits of that outer fold are used; without any, its outer folds."""
    from rankloom.operators.splits import fold_tables
    table = spark.read.parquet(folds)
    if inner is not None:
        if "outer" not in table.columns:
            raise ValueError("this fold table has no inner folds")
        table, fold = table.where(F.col("outer") == fold), inner
    return fold_tables(spark.read.parquet(features), spark.read.parquet(response), table, fold)
