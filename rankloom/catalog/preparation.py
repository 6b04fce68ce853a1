"""Scaling, splitting and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rankloom.catalog.fixtures import CELLS, SCORED, cells, hash_sql, scored, suppliers, uniform_sql
from rankloom.catalog.registry import query
from rankloom.operators import scaling as C, similarity as K, splits as P


@query("prep_01_standardise", f"""WITH {CELLS}, s AS (SELECT f, avg(x) AS m, stddev_pop(x) AS sd FROM cells WHERE g % 5 <> 0 GROUP BY f)
  SELECT g, f, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS x FROM cells JOIN s USING (f) WHERE g % 5 = 0""",
       dbl="x", num="g f")
def _(t):
    df = cells(t).select("g", "f", "x")
    return C.standardise(df.where("g % 5 <> 0"), df.where("g % 5 = 0")).select("g", "f", "x")


_STATS = f"""WITH {SCORED}, st AS (SELECT i, avg(y) AS m, stddev_pop(y) AS sd, min(y) AS lo, max(y) AS hi, max(abs(y)) AS am
  FROM scored WHERE g % 5 <> 0 GROUP BY i) SELECT g, i, {{}} AS y FROM scored JOIN st USING (i) WHERE g % 5 = 0"""


def _scaled(t, how):
    df = scored(t).select("g", "i", "y")
    return C.scale_labels(df.where("g % 5 <> 0"), df.where("g % 5 = 0"), how).select("g", "i", "y")


@query("prep_02_scale_minmax", _STATS.format("(y - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END"), dbl="y", num="g i")
def _(t):
    return _scaled(t, "minmax")


@query("prep_02_scale_maxabs", _STATS.format("y / CASE WHEN am = 0 THEN 1 ELSE am END"), dbl="y", num="g i")
def _(t):
    return _scaled(t, "maxabs")


@query("prep_03_scale_zscore", _STATS.format("(y - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END"), dbl="y", num="g i")
def _(t):
    return _scaled(t, "zscore")


def _folds_sql(seed, table="supplier", key="s_suppkey", k=5):
    return f"SELECT {key} AS g, ntile({k}) OVER (ORDER BY {hash_sql(seed, key)}, {key}) - 1 AS fold FROM {table}"


@query("prep_04_kfold", _folds_sql(42, "customer", "c_custkey", 7), num="g fold")
def _(t):
    return P.kfold(t.customer.select(F.col("c_custkey").alias("g")), 7, 42)


@query("prep_05_fold_views", f"""WITH folds AS ({_folds_sql(5)}), k AS (SELECT l_suppkey AS g1, l_partkey AS g2, max(l_tax) AS k
  FROM lineitem GROUP BY 1, 2) SELECT CASE WHEN a.fold = 2 THEN 'test' ELSE 'train' END AS side, g1, g2, k FROM k
  JOIN folds a ON a.g = g1 JOIN folds b ON b.g = g2 WHERE b.fold <> 2""", dbl="k", num="g1 g2")
def _(t):
    kernel = t.lineitem.groupBy(F.col("l_suppkey").alias("g1"), F.col("l_partkey").alias("g2")).agg(
        F.max("l_tax").alias("k"))
    train, test = P.fold_views(kernel, P.kfold(suppliers(t), 5, 5), 2)
    return (train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
            .select("side", "g1", "g2", "k"))


@query("prep_06_nested_folds", f"""WITH o AS ({_folds_sql(5)}), tr AS (SELECT a.fold AS outer_fold, b.g FROM
  (SELECT DISTINCT fold FROM o) a JOIN o b ON b.fold <> a.fold)
  SELECT outer_fold, g, ntile(4) OVER (PARTITION BY outer_fold ORDER BY {hash_sql(9, 'outer_fold', 'g')}, g) - 1 AS fold FROM tr""",
       num="outer_fold g fold")
def _(t):
    return P.nested_folds(P.kfold(suppliers(t), 5, 5), 4, 9).withColumnRenamed("outer", "outer_fold")


@query("prep_07_holdout", f"""WITH r AS (SELECT c_custkey AS g, row_number() OVER (ORDER BY {hash_sql(3, 'c_custkey')}, c_custkey) AS rn,
  count(*) OVER () AS n FROM customer) SELECT g, rn <= greatest(1, round_even(n * 0.2, 0)) AS is_val FROM r""", num="g")
def _(t):
    return P.holdout(t.customer.select(F.col("c_custkey").alias("g")), 0.2, 3)


_TOPF = """tf AS (SELECT g, i, y FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y DESC, i) AS r
  FROM scored WHERE y IS NOT NULL {w}) q WHERE r <= floor(0.02 * (SELECT count(DISTINCT i) FROM scored {w2})))"""


@query("top_02_top_fraction", f"WITH {SCORED}, {_TOPF.format(w='', w2='')} SELECT g, i, y FROM tf", dbl="y", num="g i")
def _(t):
    return P.top_fraction(scored(t), 0.02).select("g", "i", "y")


@query("prep_08_keep_k", f"""WITH {SCORED}, {_TOPF.format(w='AND g % 5 <> 0', w2='WHERE g % 5 <> 0')},
  d AS (SELECT g, i, y FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {hash_sql(21, 'g', 'i')}, i) AS r FROM tf) q
  WHERE r <= 10), ok AS (SELECT i FROM d GROUP BY i HAVING count(y) >= 2)
  SELECT 'train' AS side, g, i, y FROM d WHERE i IN (SELECT i FROM ok)
  UNION ALL SELECT 'test', g, i, y FROM scored WHERE g % 5 = 0 AND i IN (SELECT i FROM ok)""", dbl="y", num="g i")
def _(t):
    df = scored(t).select("g", "i", "y")
    train, test = P.keep_k(df.where("g % 5 <> 0"), df.where("g % 5 = 0"), 0.02, 10, 21)
    return (train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
            .select("side", "g", "i", "y"))


@query("prep_09_bootstrap", f"""WITH r AS (SELECT c_custkey AS g, row_number() OVER (ORDER BY {hash_sql('4:order', 'c_custkey')}, c_custkey) AS rn
  FROM customer), n AS (SELECT count(*) AS n FROM customer), d AS (SELECT draw, CAST(floor({uniform_sql(4, 'draw')} * n) AS BIGINT) + 1 AS rn
  FROM n, range((SELECT CAST(floor(n * 0.3) AS BIGINT) FROM n)) x(draw)) SELECT draw, g FROM d JOIN r USING (rn)""", num="draw g")
def _(t):
    return P.bootstrap(t.customer.select(F.col("c_custkey").alias("g")), 0.3, 4)


@query("prep_10_mask_labels", f"""WITH {SCORED} SELECT g, i, CASE WHEN {uniform_sql(8, 'g', 'i')} >= 0.25 THEN y END AS y FROM scored""",
       dbl="y", num="g i")
def _(t):
    return P.mask_labels(scored(t).select("g", "i", "y"), 0.25, 8)


@query("prep_11_sensitive", f"""WITH {SCORED}, m AS (SELECT i, median(y) AS m FROM scored GROUP BY i)
  SELECT g, i, y > m AS sensitive, CASE WHEN y > m THEN 1 ELSE -1 END AS signal FROM scored JOIN m USING (i) WHERE y IS NOT NULL""",
       num="g i signal")
def _(t):
    return P.sensitive(scored(t)).select("g", "i", "sensitive", "signal")


@query("prep_12_expanding_cohort", f"""WITH r AS (SELECT c_custkey AS g, row_number() OVER (ORDER BY {hash_sql(6, 'c_custkey')}, c_custkey) AS rn,
  count(*) OVER () AS n FROM customer) SELECT g, greatest(0, ceil((rn - floor(n * 0.5)) / 20.0)) AS step_id FROM r""", num="g step_id")
def _(t):
    return P.expanding_cohort(t.customer.select(F.col("c_custkey").alias("g")), 0.5, 20, 6)


@query("prep_13_median_ge0_items", """SELECT n_nationkey AS i FROM (SELECT c_nationkey AS n_nationkey, median(c_acctbal - 4500) AS m
  FROM customer GROUP BY 1) q WHERE m >= 0""", num="i")
def _(t):
    df = t.customer.select(F.col("c_nationkey").alias("i"), (F.col("c_acctbal") - 4500).alias("y"))
    return P.median_ge0_items(df)


_HOURLY = """ev AS (SELECT user_id AS g, event_type AS f, avg(value) AS x FROM events GROUP BY 1, 2)"""


@query("prep_14_concat_features", f"""WITH {CELLS}, {_HOURLY}, live AS (SELECT g FROM cells INTERSECT SELECT g FROM ev)
  SELECT g, 'vec:' || f AS f, x FROM cells WHERE g IN (SELECT g FROM live)
  UNION ALL SELECT g, 'ev:' || f, x FROM ev WHERE g IN (SELECT g FROM live)""", dbl="x", num="g")
def _(t):
    ev = t.events.groupBy(F.col("user_id").alias("g"), F.col("event_type").alias("f")).agg(F.avg("value").alias("x"))
    return C.concat_features({"vec": cells(t).select("g", "f", "x"), "ev": ev})


@query("prep_15_harmonise", f"""WITH {CELLS}, r AS (SELECT CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS batch, g, f, avg(x) AS x
  FROM cells WHERE label % 2 = 0 OR f < 60 GROUP BY 1, 2, 3), st AS (SELECT f, batch, avg(x) AS m, stddev_pop(x) AS sd, count(x) AS n
  FROM r GROUP BY 1, 2), p AS (SELECT f, sum(m * n) / sum(n) AS pm, sqrt(sum(sd * sd * n) / sum(n)) AS psd FROM st GROUP BY f
  HAVING count(*) = 2) SELECT r.batch, g, r.f, (x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END * psd + pm AS x FROM r
  JOIN st ON st.f = r.f AND st.batch = r.batch JOIN p ON p.f = r.f""", dbl="x", num="g f")
def _(t):
    df = cells(t)
    return C.harmonise(df.where("label % 2 = 0"), df.where("label % 2 = 1 and f < 60"))


@query("scl_17_augment", f"""WITH {CELLS}, st AS (SELECT f, avg(x) AS m, stddev_pop(x) AS sd FROM cells GROUP BY f),
  d AS (SELECT *, {uniform_sql('13:coin', 'g')} < 0.5 AS coin, sqrt(-2 * ln({uniform_sql('13a', 'g', 'f')}))
  * cos(6.283185307179586 * {uniform_sql('13b', 'g', 'f')}) AS z FROM cells)
  SELECT g, f, (x + CASE WHEN coin THEN 0.01 + 0.05 * z ELSE 0 END - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS x
  FROM d JOIN st USING (f)""", dbl="x", num="g f")
def _(t):
    from rankloom.operators.aggregates import column_stats
    df = cells(t).select("g", "f", "x")
    return C.augment(df, column_stats(df, ["f"], "x"), 0.05, 0.01, 13).select("g", "f", "x")


def _sides(t, folds, fold, inner=None):
    """Sizes and sums of the four tables of a fold that is stored and read back."""
    from rankloom.runtime import scratch_path
    from rankloom.sources.readers import read_fold
    folder = scratch_path(t.spark, "folds")
    cells(t).select("g", "f", "x").write.parquet(f"{folder}/x")
    scored(t).write.parquet(f"{folder}/y")
    folds.write.parquet(f"{folder}/folds")
    parts = read_fold(t.spark, f"{folder}/x", f"{folder}/y", f"{folder}/folds", fold, inner)
    total = lambda name: parts[name].agg(
        F.count("*").alias("n"), F.sum("x" if name[0] == "x" else "s").alias("total")).withColumn("part", F.lit(name))
    return reduce(DataFrame.unionByName, map(total, ("x_train", "x_test", "y_train", "y_test"))).select("part", "n", "total")


_SIDES = """, v AS (SELECT 'x_' AS part, g, x AS v FROM cells UNION ALL SELECT 'y_', g, s FROM scored)
  SELECT part || CASE WHEN fold = 1 THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(v) AS total
  FROM v JOIN folds USING (g) GROUP BY 1"""


@query("src_18_read_fold", f"WITH {SCORED}, {CELLS}, folds AS ({_folds_sql(5)}){_SIDES}", dbl="total", num="n")
def _(t):
    return _sides(t, P.kfold(suppliers(t), 5, 5), 1)


@query("src_18_read_inner_fold", f"""WITH {SCORED}, {CELLS}, o AS ({_folds_sql(5)}), tr AS (SELECT a.fold AS outer_fold, b.g FROM
  (SELECT DISTINCT fold FROM o) a JOIN o b ON b.fold <> a.fold), inn AS (SELECT outer_fold, g, ntile(4) OVER (PARTITION BY outer_fold
  ORDER BY {hash_sql(9, 'outer_fold', 'g')}, g) - 1 AS fold FROM tr), folds AS (SELECT g, fold FROM inn WHERE outer_fold = 2){_SIDES}""",
       dbl="total", num="n")
def _(t):
    return _sides(t, P.nested_folds(P.kfold(suppliers(t), 5, 5), 4, 9), 2, 1)
