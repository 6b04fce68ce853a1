"""Split paths for hot groups and long paths give what the plain ones give."""

import pytest
from pyspark.sql import Window, functions as F

from rankloom import runtime
from rankloom.operators import metrics as M, ordering as O, scans, trajectory as T


def skewed(spark, n=3000):
    """One group holds a third of the rows, half of which tie."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).alias("g"), F.col("id").alias("i"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 50) / 10.0).alias("y"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise((F.col("id") * 104729 % 997) / 10.0).alias("s"))


def test_hot_groups_are_found(spark):
    keys = runtime.hot_groups(skewed(spark), ["g"], 500)
    assert [r.g for r in keys.collect()] == [0]
    assert runtime.hot_groups(skewed(spark), ["g"], 5000) is None
    assert runtime.hot_groups(skewed(spark), ["g"]) is None  # no group of two million rows


def test_ranks(spark):
    df = skewed(spark)
    got = O.grouped_rank(df, ["g"], O.score_order("s"), "r", hot_rows=500)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(*O.score_order("s"))))
    both = got.join(want.select("i", "w"), "i")
    assert both.count() == 3000 and both.where("r <> w").count() == 0


def test_global_rank(spark):
    df = skewed(spark)
    got = O.grouped_rank(df, [], O.score_order("s"), "r")
    want = df.withColumn("w", F.row_number().over(Window.orderBy(*O.score_order("s"))))
    assert got.join(want.select("i", "w"), "i").where("r <> w").count() == 0


def test_medians(spark):
    df = skewed(spark)
    want = df.groupBy("g").agg(F.median("y").alias("w"))
    for limit in (None, 5):
        got = O.exact_median(df, ["g"], "y", hot_rows=limit)
        assert got.join(want, "g").where("abs(median - w) > 1e-12").count() == 0 and got.count() == 41


def test_metrics_on_hot_groups(spark, no_small_inputs):
    df = skewed(spark, 900)
    plain = M.cutoff_metrics(df, [7])
    full = M.path_rewards(df)
    assert full.count() == 41
    ranked = M.full_ranks(df)
    top = ranked.where("rs <= 7").groupBy("g").agg(F.sum((F.pow(F.lit(2.0), "y") - 1) / F.log2(F.col("rs") + 1)).alias("d"))
    assert plain.join(top, "g").where("abs(dcg_7 - d) > 1e-9").count() == 0


@pytest.mark.parametrize("gamma", [0.0, 0.2, 0.95, 0.9999, 1.0])
def test_chunked_returns(spark, gamma):
    n = 500
    df = spark.range(2 * n).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).alias("step"),
                                   ((F.col("id") * 31 % 17) / 7.0).alias("reward"))
    want = {}
    for g in (0, 1):
        q = 0.0
        for step in reversed(range(n)):
            q = ((2 * step + g) * 31 % 17) / 7.0 + gamma * q
            want[g, step] = q
    for chunk in (None, 7, 64):
        got = scans.discounted_suffix(df, ["g"], "step", {"q": F.col("reward")}, gamma, chunk).collect()
        assert len(got) == 2 * n
        for r in got:
            assert r.q == pytest.approx(want[r.g, r.step], rel=1e-10)


def test_chunked_gae(spark):
    df = spark.range(400).select(F.lit(1).alias("g"), F.col("id").alias("step"),
                                 (F.col("id") % 7 / 3.0).alias("reward"), (F.col("id") % 5 / 2.0).alias("value"))
    one = {r.step: (r.advantage, r.ret) for r in T.gae(df, 0.97, 0.9).collect()}
    for chunk in (16, 33):
        for r in T.gae(df, 0.97, 0.9, chunk=chunk).collect():
            assert (r.advantage, r.ret) == pytest.approx(one[r.step], rel=1e-10)


def test_chunked_prefix(spark):
    df = spark.range(300).select(F.col("id").alias("step"), (F.col("id") * 37 % 101).alias("v"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.step: (r.m, r.t) for r in df.select("step", F.max("v").over(w).alias("m"), F.sum("v").over(w).alias("t")).collect()}
    got = scans.prefix_scan(df, [], "step", {"m": ("max", F.col("v")), "t": ("sum", F.col("v"))}, True, 16)
    assert {r.step: (r.m, r.t) for r in got.collect()} == want


def test_hash_order_is_a_permutation_whatever_the_partitions(spark):
    base = spark.range(1000).withColumnRenamed("id", "g")
    runs = [{r.g: r.rn for r in O.hash_rank(base.repartition(p), "g", 5).collect()} for p in (1, 4, 13)]
    assert runs[0] == runs[1] == runs[2] and sorted(runs[0].values()) == list(range(1, 1001))


def test_top_k_is_cut_before_the_shuffle(spark):
    df = skewed(spark)
    plan = O.top_k(df, ["g"], O.score_order("s"), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
