"""Full matrices of groups and items: right cells, and no shuffle that grows with them."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import filters as X, joins as J


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_missing_cells_of_null_and_repeated_keys(spark, width):
    rows = [(g, i, None if (g + i) % 5 == 0 else 1.0) for g in range(7) for i in range(9) if (g * i) % 4 != 1]
    rows += [(1, 3, 2.0), (None, 2, 1.0), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, y double")
    have = {(g, i) for g, i, y in rows if y is not None and g is not None and i is not None}
    want = {(g, i) for g in [*range(7), None] for i in range(9)} - have
    got = [(r.g, r.i) for r in X.missing_cells(df, width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = spark.createDataFrame([(2,), (4,), (77,), (4,)], "i int")
    got = [(r.g, r.i) for r in X.missing_cells(df, items=some, width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, i) for g in [*range(7), None] for i in (2, 4, 77)} - have


def test_missing_cells_are_not_shuffled(spark):
    df = spark.createDataFrame([(f"g{g}", f"i{i}", 1.0) for g in range(5) for i in range(5) if g != i], "g string, i string, y double")
    found = X.missing_cells(df)
    assert {(r.g[1:], r.i[1:]) for r in found.collect()} == {(str(k), str(k)) for k in range(5)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    cells = plan.split("Generate explode(is")[0].split("+- Union")[-1]
    assert "Exchange" not in cells and "Join" not in cells


def test_a_pack_of_groups_meets_a_segment_once(spark):
    groups = spark.createDataFrame([(g,) for g in [*range(50), 7, None, None]], "g int").coalesce(1)
    pairs = J.expand_pairs(groups, spark.range(30).select(F.col("id").alias("i")), width=10)
    assert pairs.count() == 53 * 30 and pairs.where("g = 7").count() == 60 and pairs.where("g is null").count() == 60
    assert pairs.distinct().count() == 51 * 30
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert plan.index("Join") > plan.index("Generate explode(__gs")  # the join is below: it has packs, not groups
