"""Scalar and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import CELLS, VEC, cells, vectors
from rankloom.catalog.registry import query
from rankloom.functions import scalars as S, vectors as V
from rankloom.operators.scaling import fold_change


@query("scl_01_name_key", """SELECT c_custkey, trim(trim(lower('x' || c_name || 'Xx'), 'x')) AS k,
  trim(trim(lower(' ' || c_mktsegment || ' x'), 'x')) AS k2 FROM customer""", num="c_custkey")
def _(t):
    return t.customer.select("c_custkey", S.name_key(F.concat(F.lit("x"), "c_name", F.lit("Xx"))).alias("k"),
                             S.name_key(F.concat(F.lit(" "), "c_mktsegment", F.lit(" x"))).alias("k2"))


@query("scl_02_patient_id", """SELECT c_custkey, substr(replace(upper(replace(c_name, '#', '.')), '.', '-'), 1, 12) AS id
  FROM customer""", num="c_custkey")
def _(t):
    return t.customer.select("c_custkey", S.patient_id(F.replace("c_name", F.lit("#"), F.lit("."))).alias("id"))


@query("scl_03_short_name", "SELECT n_nationkey, lower(split_part(n_name, '_', 1)) AS k FROM nation", num="n_nationkey")
def _(t):
    return t.nation.select("n_nationkey", S.short_name("n_name").alias("k"))


@query("scl_04_symbol", "SELECT p_partkey, split_part(p_brand || '|' || p_size, '|', 1) AS k FROM part", num="p_partkey")
def _(t):
    return t.part.select("p_partkey", S.symbol(F.concat_ws("|", "p_brand", "p_size")).alias("k"))


@query("scl_05_norm_text", "SELECT c_custkey, trim(lower('  ' || c_mktsegment || ' ')) AS k FROM customer", num="c_custkey")
def _(t):
    return t.customer.select("c_custkey", S.norm_text(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("k"))


@query("scl_06_log2p1", "SELECT event_id, log2(value + 1) AS v FROM events", dbl="v", num="event_id")
def _(t):
    return t.events.select("event_id", S.log2p1("value").alias("v"))


@query("scl_07_auto_log2", """SELECT event_id, CASE WHEN (SELECT max(value) FROM events) > 100 THEN log2(value + 1)
  ELSE value END AS value, CASE WHEN (SELECT max(value / 10) FROM events) > 100 THEN log2(value / 10 + 1)
  ELSE value / 10 END AS low FROM events""", dbl="value low", num="event_id")
def _(t):
    df = t.events.select("event_id", "value", (F.col("value") / 10).alias("low"))
    return S.auto_log2(S.auto_log2(df, "value"), "low")


@query("scl_08_fold_change", f"WITH {CELLS} SELECT g, f, x - avg(x) OVER (PARTITION BY f) AS x FROM cells",
       dbl="x", num="g f")
def _(t):
    return fold_change(cells(t).select("g", "f", "x")).select("g", "f", "x")


@query("scl_08_fold_change_reference", f"""WITH {CELLS}, m AS (SELECT f, avg(x) AS m FROM cells WHERE label % 2 = 1 AND f < 40 GROUP BY f)
  SELECT g, f, x - m AS x FROM cells JOIN m USING (f) WHERE label % 2 = 0""", dbl="x", num="g f")
def _(t):
    df = cells(t)
    return fold_change(df.where("label % 2 = 0").select("g", "f", "x"), df.where("label % 2 = 1 and f < 40")).select("g", "f", "x")


@query("scl_09_ic50_measures", """SELECT event_id, 1 / (1 + pow(exp(value / 50), -0.1)) AS sens, exp(value / 50) AS lin FROM events""",
       dbl="sens lin", num="event_id")
def _(t):
    x = F.col("value") / 50
    return t.events.select("event_id", S.ic50_sensitivity(x).alias("sens"), S.ic50_linear(x).alias("lin"))


@query("scl_10_is_number", """SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type
  ELSE json_extract_string(props, '$.k') END AS DOUBLE) IS NOT NULL AS ok FROM events""", num="event_id")
def _(t):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", S.is_number(v).alias("ok"))


@query("scl_13_l2_normalise", f"""WITH {VEC} SELECT g, f, v / (sqrt(list_dot_product(x, x)) + 1e-5) AS v FROM (
  SELECT g, x, generate_subscripts(x, 1) - 1 AS f, unnest(x) AS v FROM vec) q""", dbl="v", num="g f")
def _(t):
    return vectors(t).select("g", F.posexplode(V.l2_normalise("x")).alias("f", "v"))


_PAIR = f"{VEC}, p AS (SELECT a.g, a.x, b.x AS z FROM vec a JOIN vec b ON b.g = a.g + 1)"


def _neighbours(t):
    a = vectors(t)
    return a.join(a.select((F.col("g") - 1).alias("g"), F.col("x").alias("z")), "g")


@query("scl_15_cosine_dot", f"""WITH {_PAIR} SELECT g, list_dot_product(x, z) / (greatest(sqrt(list_dot_product(x, x)), 1e-6)
  * greatest(sqrt(list_dot_product(z, z)), 1e-6)) AS cosine, list_dot_product(x, z) AS dot FROM p""",
       dbl="cosine dot", num="g")
def _(t):
    return _neighbours(t).select("g", V.cosine("x", "z").alias("cosine"), V.dot("x", "z").alias("dot"))


@query("scl_16_cross_layer", f"""WITH {_PAIR}, w AS (SELECT list(CAST(r % 5 - 2 AS DOUBLE) / 10 ORDER BY r) AS w FROM range(64) t(r)),
  q AS (SELECT g, list_dot_product(z, w) AS sw, x, z FROM p, w),
  u AS (SELECT g, sw, generate_subscripts(x, 1) - 1 AS f, unnest(x) AS xv, unnest(z) AS zv FROM q)
  SELECT g, f, xv * sw + (f % 3) / 100.0 + zv AS v FROM u""", dbl="v", num="g f")
def _(t):
    weights = [(r % 5 - 2) / 10 for r in range(64)]
    bias = [(r % 3) / 100.0 for r in range(64)]
    return _neighbours(t).select("g", F.posexplode(V.cross_layer("x", "z", weights, bias)).alias("f", "v"))


@query("scl_14_cm_to_inch", "SELECT p_partkey, p_size / 2.54 AS inch FROM part", dbl="inch", num="p_partkey")
def _(t):
    return t.part.select("p_partkey", S.cm_to_inch("p_size").alias("inch"))


@query("src_06_nan_to_null", """SELECT event_type, count(*) AS n, count(v) AS filled, avg(v) AS mean FROM (SELECT event_type,
  CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) q GROUP BY event_type""", dbl="mean", num="n filled")
def _(t):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    df = t.events.select("event_type", v.alias("v")).withColumn("v", S.nan_to_null("v"))
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("filled"), F.avg("v").alias("mean"))
