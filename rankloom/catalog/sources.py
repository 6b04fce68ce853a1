"""Readers and writers: tables go out in each file layout and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import CHOICES, EPOCHS, RUNS, choices, epoch_log, scored_runs
from rankloom.catalog.registry import query
from rankloom.plans import report
from rankloom.runtime import scratch_path
from rankloom.sources import readers as R, writers as W

TYPES = ["click", "error", "purchase", "signup", "view"]


FILES = 16


def _text(t, df, name, header=True, sep=",", compression="none"):
    """Write a derived table as a folder of delimited files and return its path."""
    path = scratch_path(t.spark, name)
    df.write.option("header", header).option("nullValue", "NA").option("sep", sep).option(
        "compression", compression).csv(path)
    return path


def _wide(t, value=None):
    """A row per user, a column per type; cells that never exceed 100 are holes."""
    high = F.max(F.when(F.col("value") > 100, F.col("value")))
    return (t.events.groupBy(F.col("user_id").cast("string").alias("id"))
            .pivot("event_type", TYPES).agg(high if value is None else value))


_MAX = "SELECT CAST(user_id AS VARCHAR) AS {g}, event_type AS {i}, max(value) AS {y} FROM events WHERE value > 100 GROUP BY 1, 2"


@query("src_01_read_matrix", _MAX.format(g="g", i="i", y="y"), dbl="y")
def _(t):
    return R.read_matrix(t.spark, _text(t, _wide(t), "matrix"))


@query("src_02_read_expression", """SELECT CAST(user_id AS VARCHAR) AS f, event_type AS g, max(value) AS x FROM events
  WHERE value > 100 GROUP BY 1, 2""", dbl="x")
def _(t):
    wide = _wide(t).select(F.col("id").alias("GENE_SYMBOLS"), F.lit("text").alias("GENE_title"),
                           *TYPES)
    wide = wide.toDF("GENE_SYMBOLS", "GENE_title", *[f"DATA.{c}" for c in TYPES])
    return R.read_expression(t.spark, _text(t, wide, "expression", sep="\t"))


def _flags(t):
    return _wide(t, F.max((F.col("value") > 150).cast("int")))


_EVENTS = "SELECT {a}, {b}, max(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS x FROM events GROUP BY user_id, event_type"


@query("src_03_events_rows", _EVENTS.format(a="event_type AS g", b="CAST(user_id AS VARCHAR) AS f"), num="x")
def _(t):
    return R.read_events(t.spark, _text(t, _flags(t), "events", sep="\t"), "rows")


@query("src_03_events_columns", _EVENTS.format(a="CAST(user_id AS VARCHAR) AS g", b="event_type AS f"), num="x")
def _(t):
    return R.read_events(t.spark, _text(t, _flags(t), "events", sep="\t"), "columns")


@query("src_04_read_region", """SELECT CAST(user_id AS VARCHAR) AS g, 'user, ' || user_id AS g_name,
  'D' || (ord(event_type[1]) % 10) AS i, event_type AS i_name, max(value) AS y FROM events WHERE value > 100
  GROUP BY user_id, event_type""", dbl="y")
def _(t):
    body = _wide(t).select(F.pmod(F.xxhash64("id"), F.lit(FILES)).alias("sheet"), F.lit(9).alias("n"), F.array_join(
        F.array("id", F.concat(F.lit('"user, '), "id", F.lit('"')), *[F.col(c).cast("string") for c in TYPES]), ",", "NA").alias("value"))
    rows = [""] * 4 + [",".join(["id", "name"] + [f"D{ord(c[0]) % 10}" for c in TYPES]), ",".join(["", ""] + TYPES)]
    top = t.spark.createDataFrame(list(enumerate(rows)), "n int, value string")
    heads = top.withColumn("sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FILES - 1).cast("long"))))
    return R.read_region(t.spark, _sheets(t, body.unionByName(heads), "region"))


def _sheets(t, lines, name, compression="none"):
    """Write (sheet, n, value) lines as one text file per sheet, in order of n."""
    path = scratch_path(t.spark, name)
    (lines.repartition("sheet").sortWithinPartitions("sheet", "n").select("sheet", "value")
     .write.partitionBy("sheet").option("compression", compression).text(path))
    return path


@query("src_05_read_thresholds", "SELECT CAST(c_nationkey AS VARCHAR) AS i, max(c_acctbal) AS thr FROM customer GROUP BY 1", dbl="thr")
def _(t):
    nations = t.customer.groupBy(F.col("c_nationkey").cast("string").alias("i")).agg(F.max("c_acctbal").alias("thr"))
    ids, thr = scratch_path(t.spark, "items"), scratch_path(t.spark, "thresholds")
    nations.select("i").orderBy("i").coalesce(1).write.text(ids)  # one line per nation
    line = nations.agg(F.sort_array(F.collect_list(F.struct("i", "thr"))).alias("a"))
    line.select(F.array_join(F.transform("a", lambda r: r["thr"].cast("string")), ",")).write.text(thr)
    return R.read_thresholds(t.spark, thr, ids)


@query("src_07_read_list", "SELECT c_name AS key FROM customer")
def _(t):
    return R.read_list(t.spark, _text(t, t.customer.select("c_name"), "list", header=False))


@query("src_08_read_delimited", "SELECT c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    row = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    body = t.customer.select((F.col("c_custkey") % FILES).alias("sheet"), F.col("c_custkey").alias("n"), F.explode(
        F.when(F.col("c_custkey") % 100 == 50, F.array(F.lit("# a note"), row)).otherwise(F.array(row))).alias("value"))
    junk = t.spark.createDataFrame([(-2, "title"), (-1, "id\tname\tsegment")], "n long, value string").withColumn(
        "sheet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FILES - 1).cast("long"))))
    path = _sheets(t, body.unionByName(junk), "delimited", "gzip")
    return R.read_delimited(t.spark, path, skip_rows=2, skip_cols=1, names=["name", "segment"])


@query("src_09_bundle", f"WITH {CHOICES} SELECT g, i, s, n FROM choices JOIN (SELECT user_id AS g, count(*) AS n FROM events GROUP BY 1) c USING (g)",
       dbl="s", num="g n")
def _(t):
    path = scratch_path(t.spark, "bundle")
    groups = t.events.groupBy(F.col("user_id").alias("g")).agg(F.count("*").alias("n"))
    W.save_bundle({"Y": choices(t), "groups": groups}, path)
    back = R.load_bundle(t.spark, path, ["Y", "groups"])
    return back["Y"].join(back["groups"], "g")


@query("src_10_write_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer", dbl="c_acctbal", num="c_custkey")
def _(t):
    path = scratch_path(t.spark, "csv")
    W.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return t.spark.read.csv(path, header=True, schema="c_custkey bigint, c_name string, c_acctbal double")


@query("src_11_write_scored", f"WITH {RUNS} SELECT g, i, y, s FROM runs WHERE method = 'A' AND fold = 2", dbl="y s", num="g i")
def _(t):
    path = scratch_path(t.spark, "scored")
    W.write_scored(scored_runs(t), path, ["method", "fold"])
    return R.read_scored(t.spark, path).where("method = 'A' and fold = 2").select("g", "i", "y", "s")


@query("src_12_missing_runs", """SELECT DISTINCT l_returnflag AS method, l_suppkey % 5 AS fold FROM lineitem
  WHERE NOT (l_returnflag = 'A' OR l_suppkey % 5 = 3)""", num="fold")
def _(t):
    path = scratch_path(t.spark, "runs")
    runs = scored_runs(t)
    W.write_scored(runs.where("method = 'A' or fold = 3"), path, ["method", "fold"])
    return W.missing_runs(runs.select("method", "fold").distinct(), path, ["method", "fold"])


@query("src_13_resolve", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1", num="c_nationkey n")
def _(t):
    path = scratch_path(t.spark, "tree")
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.csv(f"{path}/deep/below")  # one row per nation
    counts.write.parquet(f"{path}/other")
    found = R.resolve(t.spark, path, ["*.tsv", "*.csv", "*.parquet"])
    return t.spark.read.csv(found, schema="c_nationkey int, n long")


@query("src_15_format_report", f"""WITH {RUNS}, r AS (SELECT method, fold, round(avg(s), 2) AS v FROM runs GROUP BY method, fold),
  l AS (SELECT method, avg(v) AS m, string_agg(printf('%.6f', v), ' ' ORDER BY fold) AS vals FROM r GROUP BY method)
  SELECT method, method || ' NDCG mean_' || printf('%.6f', m) || ' ' || vals AS line FROM l""")
def _(t):
    folds = scored_runs(t).groupBy("method", "fold").agg(F.round(F.avg("s"), 2).alias("v"))
    return report.format_report(folds, ["method"], "NDCG", "v")


@query("src_16_epoch_log", f"WITH {EPOCHS} SELECT epoch, CAST(n AS DOUBLE) AS train_ndcg, test_ndcg FROM epochs",
       dbl="train_ndcg test_ndcg", num="epoch")
def _(t):
    path = scratch_path(t.spark, "log")
    log = epoch_log(t).select("epoch", F.col("n").cast("double").alias("train_ndcg"), F.lit(0.5).alias("train_rewards"),
                              "test_ndcg", F.lit(0.5).alias("test_rewards"))
    W.append_epoch_log(log.where("epoch < 300"), path)
    W.append_epoch_log(log.where("epoch >= 300"), path)
    return R.read_epoch_log(t.spark, path).select("epoch", "train_ndcg", "test_ndcg")


@query("src_17_read_map", "SELECT c_name AS id, c_mktsegment AS smiles FROM customer")
def _(t):
    rows = t.customer.select(F.concat("c_name", F.lit(" ")).alias("a"), F.concat(F.lit(" "), "c_mktsegment").alias("b"))
    return R.read_map(t.spark, _text(t, rows, "map", header=False, sep="\t"))
