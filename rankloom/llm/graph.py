"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge names; the component is its smallest node.

    Each round every component takes the smallest of its neighbours, chains of such choices are
    shortened by doubling, and edges inside a component go.  The minimum is taken in tasks first,
    so a node with very many edges is no hot key; its edges are a skewed join, which Spark splits.
    Edges with a null end are ignored; loops and repeated edges change nothing."""
    ends = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    left = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    left = left.where("a < b")
    while not left.isEmpty():
        # the larger end of an edge may move to the smaller
        parents = stored(left.groupBy("b").agg(F.min("a").alias("parent")).withColumnRenamed("b", "root"))
        while True:
            up = parents.select(F.col("root").alias("parent"), F.col("parent").alias("next"))
            jumped = stored(parents.join(up, "parent", "left").select("root", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
            parents = jumped.select("root", "parent")
            if jumped.where("moved").isEmpty():
                break
        labels = stored(labels.join(parents.withColumnRenamed("root", "component"), "component", "left").select(
            "node", F.coalesce("parent", "component").alias("component")))
        moved = lambda df, end: df.join(parents.withColumnRenamed("root", end), end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        ends = moved(moved(left, "a"), "b").where("a <> b")
        left = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels
