"""Null-skipping aggregates, selection and model errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import CELLS, RANKED_RUNS, SCORED, cells, scored, scored_runs
from rankloom.catalog.metrics import GAIN
from rankloom.catalog.registry import query
from rankloom.operators import aggregates as A, metrics as M


@query("agg_01_marginal_means", f"""WITH {SCORED} SELECT g, i, avg(y) AS mean FROM scored
  GROUP BY GROUPING SETS ((g), (i), ())""", dbl="mean")
def _(t):
    return A.marginal_means(scored(t))


@query("agg_02_nan_stats", f"""WITH {SCORED} SELECT a.i, mean, std FROM
  (SELECT i, avg(y) AS mean FROM scored WHERE y IS NOT NULL GROUP BY i) a JOIN
  (SELECT i, stddev_pop(y) AS std FROM scored WHERE y IS NOT NULL GROUP BY i) b USING (i)""",
       dbl="mean std", num="i")
def _(t):
    df = scored(t)
    return A.nan_stat(df, "y", "mean", ["i"]).join(A.nan_stat(df, "y", "std", ["i"]), "i")


@query("udf_01_pluggable_statistic", f"WITH {SCORED} SELECT g, max(y) - min(y) AS spread FROM scored WHERE y IS NOT NULL GROUP BY g",
       dbl="spread", num="g")
def _(t):
    return A.nan_stat(scored(t), "y", lambda c: F.max(c) - F.min(c), ["g"], "spread")


@query("agg_03_collapse_mean", "SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY user_id, event_type",
       dbl="x", num="user_id")
def _(t):
    return A.collapse_mean(t.events.withColumnRenamed("value", "x"), ["user_id", "event_type"])


@query("agg_04_weighted_mean", """SELECT l_suppkey AS g, sum(v * w) / nullif(sum(w), 0) AS wmean FROM
  (SELECT l_suppkey, l_discount AS v, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS w FROM lineitem) q
  WHERE v IS NOT NULL AND w IS NOT NULL GROUP BY l_suppkey""", dbl="wmean", num="g")
def _(t):
    df = t.lineitem.select(F.col("l_suppkey").alias("g"), F.col("l_discount").alias("v"),
                           F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("w"))
    return A.weighted_mean(df, "v", "w", ["g"])


@query("udf_02_group_callable", "SELECT l_suppkey AS g, sum(l_discount * l_tax) / nullif(sum(l_tax), 0) AS wmean FROM lineitem GROUP BY l_suppkey",
       dbl="wmean", num="g")
def _(t):
    return A.weighted_mean(t.lineitem.withColumnRenamed("l_suppkey", "g"), "l_discount", "l_tax", ["g"])


@query("agg_05_value_range", f"WITH {SCORED} SELECT min(y) AS lo, max(y) AS hi FROM scored", dbl="lo hi")
def _(t):
    return A.value_range(scored(t), "y")


@query("agg_08_median_impute", f"""WITH {SCORED}, q AS (SELECT g, i, CASE WHEN g % 9 <> 0 THEN y END AS y FROM scored),
  m AS (SELECT i, median(y) AS med FROM q GROUP BY i)
  SELECT g, q.i, coalesce(y, med) AS y FROM q LEFT JOIN m ON m.i = q.i""", dbl="y", num="g i")
def _(t):
    df = scored(t).select("g", "i", F.when(F.col("g") % 9 != 0, F.col("y")).alias("y"))
    return A.median_impute(df, "y", ["i"]).select("g", "i", "y")


@query("agg_08_exact_median", f"WITH {SCORED} SELECT g, median(s) AS median FROM scored GROUP BY g", dbl="median", num="g")
def _(t):
    from rankloom.operators.ordering import exact_median
    return exact_median(scored(t), ["g"], "s")


_GRID = f"""WITH {RANKED_RUNS}, per AS (SELECT method, fold, g,
  sum(CASE WHEN rs <= 5 THEN {GAIN} / log2(rs + 1) END)
  / nullif(sum(CASE WHEN ry <= 5 THEN {GAIN} / log2(ry + 1) END), 0) AS v FROM ranked GROUP BY method, fold, g),
  m AS (SELECT method, fold, avg(v) AS ndcg FROM per GROUP BY method, fold)"""


@query("agg_11_select_best", f"""{_GRID} SELECT fold, method, ndcg FROM (SELECT *,
  row_number() OVER (PARTITION BY fold ORDER BY ndcg DESC, method) AS r FROM m) q WHERE r = 1""",
       dbl="ndcg", num="fold")
def _(t):
    per = M.ndcg(scored_runs(t), 5, by=["method", "fold", "g"])
    grid = per.groupBy("method", "fold").agg(F.avg("ndcg").alias("ndcg"))
    return A.select_best(grid, ["fold"], "ndcg", [F.col("method").asc()])


@query("agg_16_masked_mse", f"WITH {SCORED} SELECT avg((s - y) * (s - y)) AS mse FROM scored", dbl="mse")
def _(t):
    return A.masked_mse(scored(t))


@query("agg_17_masked_rmse", f"WITH {SCORED} SELECT g, sqrt(avg((s - y) * (s - y))) AS rmse FROM scored GROUP BY g",
       dbl="rmse", num="g")
def _(t):
    return A.masked_rmse(scored(t), by=["g"])


@query("agg_22_column_stats", f"""WITH {SCORED} SELECT i, avg(y) AS mean, stddev_pop(y) AS std, min(y) AS lo,
  max(y) AS hi, max(abs(y)) AS absmax FROM scored WHERE g % 5 <> 0 GROUP BY i""", dbl="mean std lo hi absmax", num="i")
def _(t):
    return A.column_stats(scored(t).where("g % 5 <> 0"))


@query("agg_02_feature_stats", f"""WITH {CELLS} SELECT f, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi,
  max(abs(x)) AS absmax FROM cells GROUP BY f""", dbl="mean std lo hi absmax", num="f")
def _(t):
    return A.column_stats(cells(t), ["f"], "x")
