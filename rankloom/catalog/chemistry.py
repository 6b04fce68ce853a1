"""Event matrices and token tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.registry import query
from rankloom.functions import scalars as S
from rankloom.operators import aggregates as A

def _when():
    return F.struct("ts", "event_id")


def _last_sql(cols: str, keys: str) -> str:
    return f"(SELECT {cols} FROM events QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC, event_id DESC) = 1)"


@query("agg_12_pivot_matrix", f"""WITH last AS (SELECT user_id AS g, event_type AS i,
  CASE WHEN value > 100 THEN value END AS x FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
  SELECT a.g, b.i, coalesce(x, -1) AS x FROM (SELECT DISTINCT g FROM last) a CROSS JOIN (SELECT DISTINCT i FROM last) b
  LEFT JOIN last l ON l.g = a.g AND l.i = b.i""", dbl="x", num="g")
def _(t):
    ev = t.events.select(F.col("user_id").alias("g"), F.col("event_type").alias("i"),
                         F.when(F.col("value") > 100, F.col("value")).alias("x"), "ts", "event_id")
    return A.pivot_matrix(ev, "g", "i", "x", _when())


@query("agg_13_last_attrs", f"SELECT user_id AS g, event_type, value FROM {_last_sql('*', 'user_id')} q", dbl="value", num="g")
def _(t):
    return A.last_attrs(t.events.withColumnRenamed("user_id", "g"), "g", ["event_type", "value"], _when())


@query("agg_14_pivot_measures", f"""SELECT user_id AS g, event_type AS i, value AS ln_ic50, 1 / (1 + pow(exp(value / 50), -0.1)) AS sens,
  exp(value / 50) AS lin, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS auc
  FROM {_last_sql('*', 'user_id, event_type')} q""", dbl="ln_ic50 sens lin auc", num="g")
def _(t):
    x = F.col("value") / 50
    ev = t.events.select(F.col("user_id").alias("g"), F.col("event_type").alias("i"), "value", "props", "ts", "event_id")
    return A.pivot_measures(ev, ["g", "i"], {
        "ln_ic50": F.col("value"), "sens": S.ic50_sensitivity(x), "lin": S.ic50_linear(x),
        "auc": F.get_json_object("props", "$.k").cast("double")}, _when())


_TOKENS = """tok AS (SELECT p_partkey, regexp_extract_all(p_name, '.[a-z]|.') AS raw FROM part),
  toks AS (SELECT p_partkey, CASE WHEN len(raw) > 0 AND regexp_matches(raw[-1], '^[a-z]$') THEN raw[1:len(raw) - 1] ELSE raw END AS t FROM tok)"""


def _tokens(t):
    return t.part.select("p_partkey", S.smiles_tokens("p_name").alias("t"))


@query("scl_11_smiles_tokens", f"WITH {_TOKENS} SELECT p_partkey, array_to_string(t, '~') AS tokens FROM toks", num="p_partkey")
def _(t):
    return _tokens(t).select("p_partkey", F.array_join("t", "~").alias("tokens"))


@query("agg_15_charset", f"""WITH {_TOKENS} SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (
  SELECT DISTINCT unnest(t) AS token FROM toks) q""", num="idx")
def _(t):
    return A.charset(_tokens(t), "t")


@query("agg_15_max_tokens", f"WITH {_TOKENS} SELECT max(len(t)) AS max_tokens FROM toks", num="max_tokens")
def _(t):
    return A.max_tokens(_tokens(t), "t")


@query("scl_12_one_hot", f"""WITH {_TOKENS}, c AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (
  SELECT DISTINCT unnest(t) AS token FROM toks) q), u AS (SELECT p_partkey, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM toks)
  SELECT p_partkey, pos, idx FROM u JOIN c USING (token)""", num="p_partkey pos idx")
def _(t):
    return A.one_hot(_tokens(t), "p_partkey", "t")
