"""Alignment, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import SCORED, VEC, scored, suppliers, vectors
from rankloom.catalog.registry import query
from rankloom.functions import scalars as S
from rankloom.operators import filters as X, joins as J
from rankloom.operators.ordering import grouped_rank


@query("join_01_intersect_index", """WITH a AS (SELECT o_custkey AS id, o_orderkey AS pos FROM orders),
  b AS (SELECT c_custkey AS id, c_custkey * 2 AS pos FROM customer WHERE c_mktsegment = 'MACHINERY')
  SELECT a.id, a.pos AS index1, b.pos AS index2 FROM a JOIN b USING (id)""", num="id index1 index2")
def _(t):
    a = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"))
    b = t.customer.where("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 2).alias("pos"))
    return J.intersect_index(a, b)


@query("join_02_align", f"""WITH {SCORED}, {VEC} SELECT 'x' AS side, g, len(x) AS v FROM vec WHERE g IN (SELECT g FROM scored)
  UNION ALL SELECT 'y', g, count(*) FROM scored WHERE g IN (SELECT g FROM vec) GROUP BY g""", num="g v")
def _(t):
    x, y = J.align(vectors(t), scored(t))
    return x.select(F.lit("x").alias("side"), "g", F.size("x").cast("long").alias("v")).unionByName(
        y.groupBy("g").agg(F.count("*").alias("v")).select(F.lit("y").alias("side"), "g", "v"))


@query("join_03_align_by_name", """SELECT s_suppkey, c_custkey, replace(lower(s_name), 'supplier', 'customer') AS name_key
  FROM supplier JOIN customer ON lower(c_name) = replace(lower(s_name), 'supplier', 'customer')""",
       num="s_suppkey c_custkey")
def _(t):
    norm = lambda c: F.regexp_replace(S.name_key(c), "^supplier", "customer")
    out = J.align_by_name(t.supplier, t.customer, norm, "s_name", "c_name")
    return out.select("s_suppkey", "c_custkey", "name_key")


@query("join_04_lookup", """SELECT count(p_partkey) AS matched, count(*) - count(p_partkey) AS unmatched FROM lineitem
  LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) p ON p_partkey = l_partkey""", num="matched unmatched")
def _(t):
    df = t.lineitem.select(F.col("l_partkey").alias("i"))
    dim = t.part.where("p_size > 10").select(F.col("p_partkey").alias("i"))
    hit, missed = J.lookup(df, dim, "i")
    counts = hit.agg(F.count("*").alias("matched")).withColumn("k", F.lit(1))
    return counts.join(missed.withColumn("k", F.lit(1)), "k").drop("k")


@query("join_05_map_ids", """SELECT o_orderkey, c_name AS o_custkey FROM orders JOIN customer
  ON c_custkey = o_custkey WHERE c_acctbal > 0""", num="o_orderkey")
def _(t):
    mapping = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.map_ids(t.orders.select("o_orderkey", "o_custkey"), mapping, "o_custkey", "c_name")


_SOURCES = """ids AS (SELECT s_suppkey AS g FROM supplier UNION SELECT user_id FROM events),
  a AS (SELECT s_suppkey AS g, s_name FROM supplier), b AS (SELECT DISTINCT user_id AS g,
  CASE WHEN value > 100 THEN event_type END AS event_type FROM events)"""


def _sources(t):
    a = t.supplier.select(F.col("s_suppkey").alias("g"), "s_name")
    b = t.events.select(F.col("user_id").alias("g"), F.when(F.col("value") > 100, F.col("event_type")).alias("event_type")).distinct()
    return J.all_keys(a, t.events.select(F.col("user_id").alias("g")), key="g"), a, b


@query("join_06_assemble", f"WITH {_SOURCES} SELECT g, s_name, event_type FROM ids LEFT JOIN a USING (g) LEFT JOIN b USING (g)",
       num="g")
def _(t):
    ids, a, b = _sources(t)
    return J.assemble(ids, [a, b], "g")


@query("join_06_assemble_dedup", f"""WITH {_SOURCES} SELECT g, s_name, event_type FROM ids LEFT JOIN a USING (g)
  LEFT JOIN (SELECT g, min(event_type) AS event_type FROM b GROUP BY g) c USING (g)""", num="g")
def _(t):
    ids, a, b = _sources(t)
    return J.assemble(ids, [a, b], "g", dedup=True)


@query("join_07_flag_members", """SELECT s_suppkey AS g, s_suppkey IN (SELECT l_suppkey FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity = 50) AS germline FROM supplier""", num="g")
def _(t):
    hits = t.lineitem.where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_suppkey").alias("g"))
    return J.flag_members(suppliers(t), hits, "g", "germline")


@query("join_08_expand_pairs", "SELECT s_suppkey AS g, p_partkey AS i FROM supplier CROSS JOIN part", num="g i")
def _(t):
    return J.expand_pairs(suppliers(t), t.part.select(F.col("p_partkey").alias("i")))


@query("join_09_anchor_wins", f"""WITH {SCORED}, k AS (SELECT DISTINCT g FROM scored)
  SELECT k.g, c.i, coalesce(a.s, 0) > coalesce(b.s, 0) AS win FROM k CROSS JOIN (VALUES (2), (3), (4), (5), (6)) c(i)
  LEFT JOIN scored a ON a.g = k.g AND a.i = 1 LEFT JOIN scored b ON b.g = k.g AND b.i = c.i""", num="g i")
def _(t):
    return J.anchor_wins(scored(t), 1, [2, 3, 4, 5, 6])


@query("join_10_resolve_items", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_17')",
       num="n_nationkey")
def _(t):
    return J.resolve_items(t.nation.select("n_nationkey", "n_name"), ["Nation_3", "NATION_17"], "n_name")


@query("join_11_merge_maps", """WITH b AS (SELECT o_custkey AS id, min(o_orderpriority) AS v FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY o_custkey)
  SELECT coalesce(b.id, c_custkey) AS id, coalesce(b.v, c_mktsegment) AS v FROM customer FULL JOIN b ON c_custkey = b.id""",
       num="id")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    b = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("v"))
    known = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    return J.merge_maps(a, b, "id", "v", known)


@query("join_12_attach_names", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey",
       num="c_custkey")
def _(t):
    names = t.nation.select(F.col("n_nationkey").alias("cid"), "n_name")
    return J.attach_names(t.customer.withColumnRenamed("c_nationkey", "cid"), names).select("c_custkey", "c_name", "n_name")


@query("src_14_check_aligned", """WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1),
  b AS (SELECT s_suppkey AS k, count(*) AS n FROM supplier WHERE s_suppkey % 10 <> 7 GROUP BY 1)
  SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS subject, CASE WHEN a.n IS NULL THEN 'missing_left' WHEN b.n IS NULL
  THEN 'missing_right' WHEN a.n > 1 THEN 'duplicate_left' ELSE 'duplicate_right' END AS violation
  FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS NULL OR b.n IS NULL OR a.n > 1 OR b.n > 1""")
def _(t):
    a = t.lineitem.where("l_suppkey % 10 <> 3").select(F.col("l_suppkey").alias("k"))
    b = t.supplier.where("s_suppkey % 10 <> 7").select(F.col("s_suppkey").alias("k"))
    return J.check_aligned(a, b, "k")


@query("set_01_common_keys", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0",
       num="k")
def _(t):
    return J.common_keys(t.orders.select(F.col("o_custkey").alias("k")),
                         t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), "k")


@query("set_02_all_keys", "SELECT s_suppkey AS k FROM supplier UNION SELECT user_id FROM events UNION SELECT p_partkey FROM part",
       num="k")
def _(t):
    return J.all_keys(t.supplier.select(F.col("s_suppkey").alias("k")), t.events.select(F.col("user_id").alias("k")),
                      t.part.select(F.col("p_partkey").alias("k")), key="k")


@query("set_03_ordered_common", """SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos
  FROM part QUALIFY p_partkey IN (SELECT s_suppkey FROM supplier) AND p_partkey IN (SELECT user_id FROM events)""",
       num="k pos")
def _(t):
    listed = grouped_rank(t.part.select(F.col("p_partkey").alias("k"), "p_retailprice"), [],
                          [F.col("p_retailprice").desc(), F.col("k").asc()], "pos")
    return J.ordered_common(listed, t.supplier.select(F.col("s_suppkey").alias("k")),
                            t.events.select(F.col("user_id").alias("k")), "k")


@query("set_04_union_tokens", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part")
def _(t):
    return J.union_tokens(t.part.select(F.split("p_name", " ").alias("tokens")), "tokens")


@query("set_05_complement", "SELECT s_suppkey AS g, s_suppkey % 5 AS fold FROM supplier WHERE s_suppkey % 5 <> 2", num="g fold")
def _(t):
    return J.complement(suppliers(t).withColumn("fold", F.col("g") % 5), 2)


@query("top_03_sorted_ids", "SELECT DISTINCT o_custkey FROM orders ORDER BY 1", num="o_custkey")
def _(t):
    return J.sorted_ids(t.orders, "o_custkey")


_ITEMS = "SELECT p_partkey AS i, [p_size / 10.0, p_retailprice / 1000, 1.0, p_partkey % 7] AS q, p_size / 50.0 AS b FROM part"
_GROUPS = "SELECT s_suppkey AS g, [s_acctbal / 1000, s_suppkey % 3, 0.5, s_nationkey / 25.0] AS p FROM supplier"


@query("join_19_factor_scores", f"""WITH {SCORED}, q AS ({_ITEMS}), p AS ({_GROUPS})
  SELECT g, i, list_dot_product(CAST(p AS DOUBLE[]), CAST(q AS DOUBLE[])) + 1.5 + b AS s FROM (SELECT g, i FROM scored) r
  JOIN p USING (g) JOIN q USING (i)""", dbl="s", num="g i")
def _(t):
    d = lambda *cs: F.array(*[F.expr(c).cast("double") for c in cs])
    p = t.supplier.select(F.col("s_suppkey").alias("g"),
                          d("s_acctbal / 1000", "s_suppkey % 3", "0.5D", "s_nationkey / 25.0D").alias("p"))
    q = t.part.select(F.col("p_partkey").alias("i"),
                      d("p_size / 10.0D", "p_retailprice / 1000", "1.0D", "p_partkey % 7").alias("q"),
                      F.expr("p_size / 50.0D").alias("b"))
    return J.factor_scores(scored(t).select("g", "i"), p, q, 1.5)


@query("join_18_kernel_predict", """WITH k AS (SELECT l_suppkey AS g, l_orderkey % 200 AS t, avg(l_discount) AS k FROM lineitem
  GROUP BY 1, 2), w AS (SELECT user_id AS t, event_type AS i, avg(value) / 100 AS w FROM events GROUP BY 1, 2)
  SELECT g, i, sum(k * w) AS s FROM k JOIN w USING (t) GROUP BY g, i""", dbl="s", num="g")
def _(t):
    kernel = t.lineitem.groupBy(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") % 200).alias("t")).agg(
        F.avg("l_discount").alias("k"))
    weights = t.events.groupBy(F.col("user_id").alias("t"), F.col("event_type").alias("i")).agg(
        (F.avg("value") / 100).alias("w"))
    return J.kernel_predict(kernel, weights)


@query("fit_07_kernel_predict_wide", """WITH k AS (SELECT c_nationkey AS g, c_custkey AS t, max(c_acctbal) / 1000 AS k FROM customer
  GROUP BY 1, 2), w AS (SELECT o_custkey AS t, o_orderpriority AS i, count(*) AS w FROM orders GROUP BY 1, 2)
  SELECT g, i, sum(k * w) AS s FROM k JOIN w USING (t) GROUP BY g, i""", dbl="s", num="g")
def _(t):
    kernel = t.customer.groupBy(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("t")).agg(
        (F.max("c_acctbal") / 1000).alias("k"))
    weights = t.orders.groupBy(F.col("o_custkey").alias("t"), F.col("o_orderpriority").alias("i")).agg(
        F.count("*").alias("w"))
    return J.kernel_predict(kernel, weights)
