"""Products of sparse tables by blocks against plain joins and sums."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators.blocks import block_product, summed


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    draw = lambda rows, cols, share: [(r, c, None if rng.random() < 0.1 else rng.uniform(-1, 1))
                                      for r in rows for c in cols if rng.random() < share]
    a = draw([*range(17), None], ["p", "q", "r", "s", "t", "u", None, "only a"], 0.5)
    b = draw(["p", "q", "r", "s", "t", "u", None, "only b"], range(23), 0.4)
    a += a[:5]  # repeated rows count again
    return spark.createDataFrame(a, "g int, t string, k double"), spark.createDataFrame(b, "t string, i int, w double")


def rows(df):
    return sorted(((r.g, r.i, None if r.s is None else round(r.s, 9)) for r in df.collect()), key=repr)


def joined(a, b):
    return a.where("g IS NOT NULL").join(b, "t").groupBy("g", "i").agg(F.sum(F.col("k") * F.col("w")).alias("s"))


@pytest.mark.parametrize("side", [1024, 5, 1])
def test_product_is_the_join(tables, side):
    a, b = tables
    assert rows(block_product(a, b, "g", "t", "i", "k", "w", "s", side=side)) == rows(joined(a, b))


@pytest.mark.parametrize("side", [1024, 4])
def test_only_the_wanted_cells(spark, tables, side):
    a, b = tables
    wanted = spark.createDataFrame([(g, i) for g in range(20) for i in range(25) if (g + i) % 3 == 0] + [(None, 1), (1, None), (3, 3)], "g int, i int")
    got = block_product(a, b, "g", "t", "i", "k", "w", "s", only=wanted, side=side)
    assert rows(got) == rows(joined(a, b).join(wanted, ["g", "i"], "left_semi"))


def test_empty_products(spark, tables):
    a, b = tables
    for x, y in ((a.where("false"), b), (a, b.where("false")), (a, b.withColumn("t", F.lit("none")))):
        assert block_product(x, y, "g", "t", "i", "k", "w", "s").count() == 0
    assert block_product(a, b, "g", "t", "i", "k", "w", "s", only=a.select("g", F.lit(1).alias("i")).where("false")).count() == 0


def test_no_row_for_a_product(tables):
    a, b = tables
    plan = block_product(a, b, "g", "t", "i", "k", "w", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


def test_sums_keep_their_order(spark):
    parts = spark.createDataFrame([(n % 3, n, [float(n), 0.1 * n]) for n in range(60)], "k int, at int, moments array<double>").repartition(7)
    got = {r.k: r.moments for r in summed(parts, "k", "at").collect()}
    for k in range(3):
        want = [0.0, 0.0]
        for n in range(k, 60, 3):
            want = [want[0] + n, want[1] + 0.1 * n]
        assert got[k] == want
