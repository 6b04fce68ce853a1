"""Ranking tables derived from the star schema, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.catalog.registry import Tables
from rankloom.operators.scans import add_steps


def _label():
    return F.when(F.col("l_partkey") % 7 != 0, F.max("l_quantity") / 10).alias("y")


def _score():
    return (F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("s")


def scored(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("i")).agg(_label(), _score())


def scored_runs(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 5).alias("fold"),
        F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("i")).agg(_label(), _score())


_MEASURES = """CASE WHEN l_partkey % 7 <> 0 THEN max(l_quantity) / 10 END AS y,
  max(l_extendedprice * (1 - l_discount)) / 1000 AS s"""

SCORED = f"""scored AS (SELECT l_suppkey AS g, l_partkey AS i, {_MEASURES}
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""

RUNS = f"""runs AS (SELECT l_returnflag AS method, l_suppkey % 5 AS fold, l_suppkey AS g, l_partkey AS i,
  {_MEASURES} FROM lineitem GROUP BY l_returnflag, l_suppkey, l_partkey)"""

# Observed rows with predicted and true rank.
RANKED = SCORED + """, ranked AS (SELECT *,
  row_number() OVER (PARTITION BY g ORDER BY s DESC NULLS LAST, i) AS rs,
  row_number() OVER (PARTITION BY g ORDER BY y DESC, i) AS ry,
  count(*) OVER (PARTITION BY g) AS n FROM scored WHERE y IS NOT NULL)"""

RANKED_RUNS = RUNS + """, ranked AS (SELECT *,
  row_number() OVER (PARTITION BY method, fold, g ORDER BY s DESC NULLS LAST, i) AS rs,
  row_number() OVER (PARTITION BY method, fold, g ORDER BY y DESC, i) AS ry,
  count(*) OVER (PARTITION BY method, fold, g) AS n FROM runs WHERE y IS NOT NULL)"""


def thresholds(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("i"), (F.col("p_size") / 10).alias("thr"))


def economy(t: Tables) -> DataFrame:
    return t.part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("i"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("g"),
                               F.transform("embedding", lambda x: x.cast("double")).alias("x"))


VEC = "vec AS (SELECT vec_id AS g, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def cells(t: Tables) -> DataFrame:
    """Long feature rows with the label of their sample."""
    return t.embeddings.select(F.col("vec_id").alias("g"), "label",
                               F.posexplode("embedding").alias("f", "x")).withColumn("x", F.col("x").cast("double"))


CELLS = """cells AS (SELECT vec_id AS g, label, generate_subscripts(embedding, 1) - 1 AS f,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def traj(t: Tables) -> DataFrame:
    mean = t.events.groupBy("user_id").agg((F.avg("value") / 100).alias("value"))
    rows = t.events.select("user_id", "event_id", "ts", (F.col("value") / 100).alias("reward"))
    steps = add_steps(rows, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()])
    return steps.join(mean, "user_id").select(F.col("user_id").alias("g"), "step", "reward", "value")


TRAJ = """traj AS (SELECT user_id AS g,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
  value / 100 AS reward, avg(value) OVER (PARTITION BY user_id) / 100 AS value,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def choices(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("g"), F.col("event_type").alias("i")).agg(
        (F.max("value") / 100).alias("s"))


CHOICES = """choices AS (SELECT user_id AS g, event_type AS i, max(value) / 100 AS s
  FROM events GROUP BY user_id, event_type)"""


def epoch_log(t: Tables) -> DataFrame:
    """One row per hour of events, in time order."""
    from rankloom.operators.ordering import grouped_rank
    hours = t.events.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        F.max("value").alias("test_ndcg"), F.count("*").alias("n"))
    return (grouped_rank(hours, [], [F.col("h").asc()], "epoch")
            .select((F.col("epoch") - 1).alias("epoch"), "test_ndcg", "n"))


EPOCHS = """epochs AS (SELECT row_number() OVER (ORDER BY date_trunc('hour', ts)) - 1 AS epoch,
  max(value) AS test_ndcg, count(*) AS n FROM events GROUP BY date_trunc('hour', ts))"""


def uniform_sql(seed, *keys: str) -> str:
    joined = "||':'||".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"((CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def hash_sql(seed, *keys: str) -> str:
    joined = "||':'||".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"md5({joined})"


def suppliers(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("g"))


def clinical(t: Tables) -> DataFrame:
    def cases(mod: int):
        return (F.when(F.col("g") % mod == 0, "positive").when(F.col("g") % mod == 1, "negative")
                .otherwise("equivocal"))
    from rankloom.operators.joins import flag_members
    hits = t.lineitem.where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_suppkey").alias("g"))
    base = t.supplier.select(F.col("s_suppkey").alias("g"), "s_acctbal")
    flagged = flag_members(base, hits, "g", "BRCA_germline")
    return flagged.select(
        "g", cases(3).alias("HER2"), cases(2).alias("ER"), cases(5).alias("PR"),
        F.when(F.col("g") % 11 != 0, F.col("s_acctbal") / 5000).alias("CHR17"), "BRCA_germline",
        F.when(F.col("g") % 13 != 0, F.col("s_acctbal") / 1000 - 5).alias("JAK2_RPPA"))


def _cases_sql(mod: int) -> str:
    return f"CASE s_suppkey % {mod} WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'equivocal' END"


CLINICAL = f"""clinical AS (SELECT s_suppkey AS g, {_cases_sql(3)} AS HER2, {_cases_sql(2)} AS ER,
  {_cases_sql(5)} AS PR, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal / 5000 END AS CHR17,
  s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50) AS BRCA_germline,
  CASE WHEN s_suppkey % 13 <> 0 THEN s_acctbal / 1000 - 5 END AS JAK2_RPPA FROM supplier)"""
