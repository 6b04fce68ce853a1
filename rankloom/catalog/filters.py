"""Filters and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import CELLS, RANKED_RUNS, SCORED, cells, economy, scored, scored_runs, thresholds
from rankloom.catalog.metrics import GAIN
from rankloom.catalog.registry import query
from rankloom.operators import filters as X, metrics as M


@query("flt_01_normalise_response", f"""WITH {SCORED} SELECT g, i, p_size / 10.0 - s AS y FROM scored
  JOIN part ON p_partkey = i""", dbl="y", num="g i")
def _(t):
    raw = scored(t).select("g", "i", F.col("s").alias("ic50"))
    return X.normalise_response(raw, thresholds(t)).select("g", "i", "y")


@query("flt_02_shift_nonneg", f"WITH {SCORED} SELECT g, i, s - (SELECT min(s) FROM scored) AS s FROM scored",
       dbl="s", num="g i")
def _(t):
    return X.shift_nonneg(scored(t).select("g", "i", "s"), "s")


@query("flt_03_keep_items", f"""WITH {SCORED} SELECT g, i, y FROM scored
  WHERE i IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""", dbl="y", num="g i")
def _(t):
    return X.keep_items(scored(t).select("g", "i", "y"), economy(t))


@query("flt_03_keep_items_no_list", f"WITH {SCORED} SELECT g, i, y FROM scored", dbl="y", num="g i")
def _(t):
    return X.keep_items(scored(t).select("g", "i", "y"))


@query("flt_04_keep_features", f"WITH {CELLS} SELECT g, f, x FROM cells WHERE f IN (SELECT p_size FROM part)",
       dbl="x", num="g f")
def _(t):
    listed = t.part.select(F.col("p_size").alias("f")).distinct()
    return X.keep_features(cells(t).select("g", "f", "x"), listed)


@query("flt_05_drop_empty_groups", f"""WITH {SCORED} SELECT i AS g, g AS i, y FROM scored
  WHERE i IN (SELECT i FROM scored GROUP BY i HAVING count(y) > 0)""", dbl="y", num="g i")
def _(t):
    # parts as groups: every seventh part has no label at all
    return X.drop_empty_groups(scored(t).select(F.col("i").alias("g"), F.col("g").alias("i"), "y"))


@query("flt_06_restrict_pairs", """WITH k AS (SELECT l_suppkey AS g1, l_partkey AS g2, max(l_quantity) AS k
  FROM lineitem GROUP BY 1, 2), live AS (SELECT s_suppkey AS g FROM supplier WHERE s_acctbal > 3000)
  SELECT * FROM k WHERE g1 IN (SELECT g FROM live) AND g2 IN (SELECT g FROM live)""", dbl="k", num="g1 g2")
def _(t):
    pairs = t.lineitem.groupBy(F.col("l_suppkey").alias("g1"), F.col("l_partkey").alias("g2")).agg(
        F.max("l_quantity").alias("k"))
    live = t.supplier.where("s_acctbal > 3000").select(F.col("s_suppkey").alias("g"))
    return X.restrict_pairs(pairs, live)


_GAPS = f"""{CELLS}, holes AS (SELECT g, f, label, CASE WHEN NOT (f % 9 = 4 AND g % 50 = 3) THEN x END AS x FROM cells)"""


def _holes(t):
    return cells(t).withColumn("x", F.when(~((F.col("f") % 9 == 4) & (F.col("g") % 50 == 3)), F.col("x")))


@query("flt_07_complete_features", f"""WITH {_GAPS}, whole AS (SELECT f FROM holes WHERE label < 5 GROUP BY f
  HAVING count(*) = count(x)) SELECT label < 5 AS target, g, f, x FROM holes WHERE f IN (SELECT f FROM whole)""",
       dbl="x", num="g f")
def _(t):
    df = _holes(t)
    a, b = X.complete_features(df.where("label < 5"), df.where("label >= 5"))
    return a.unionByName(b).select((F.col("label") < 5).alias("target"), "g", "f", "x")


@query("flt_08_min_labels", f"""WITH {SCORED} SELECT i AS g, g AS i, y FROM scored WHERE i IN
  (SELECT i FROM scored GROUP BY i HAVING count(y) > 25)""", dbl="y", num="g i")
def _(t):
    return X.min_labels(scored(t).select(F.col("i").alias("g"), F.col("g").alias("i"), "y"), n=25)


@query("flt_09_min_item_labels", f"""WITH {SCORED}, ok AS (SELECT i FROM scored WHERE g % 5 <> 0 GROUP BY i
  HAVING count(y) >= 20) SELECT g % 5 = 0 AS test, g, i, y FROM scored WHERE i IN (SELECT i FROM ok)""",
       dbl="y", num="g i")
def _(t):
    df = scored(t).select("g", "i", "y")
    a, b = X.min_item_labels(df.where("g % 5 <> 0"), df.where("g % 5 = 0"), 20)
    return a.unionByName(b).select((F.col("g") % 5 == 0).alias("test"), "g", "i", "y")


@query("flt_10_complete_groups", """WITH m AS (SELECT user_id AS g, event_type AS f, max(CASE WHEN value > 120 THEN value END) AS x
  FROM events GROUP BY 1, 2) SELECT * FROM m WHERE g IN (SELECT g FROM m GROUP BY g HAVING count(x) = 5)""",
       dbl="x", num="g")
def _(t):
    m = (t.events.groupBy(F.col("user_id").alias("g"), F.col("event_type").alias("f"))
         .agg(F.max(F.when(F.col("value") > 120, F.col("value"))).alias("x")))
    return X.complete_groups(m, 5)


@query("flt_11_extreme_items", f"WITH {SCORED} SELECT i, max(s) AS max_label FROM scored GROUP BY i HAVING max(s) > 90",
       dbl="max_label", num="i")
def _(t):
    return X.extreme_items(scored(t), 90.0, label="s")


@query("flt_12_primary_only", """SELECT c_custkey, c_name FROM customer
  WHERE substr(c_name, 14, 2) = '01'""", num="c_custkey")
def _(t):
    return X.primary_only(t.customer.select("c_custkey", "c_name"), "c_name")


@query("flt_13_filter_in", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
  WHERE CAST(l_linenumber AS VARCHAR) IN ('3', 'chr3')""", num="l_orderkey l_linenumber l_partkey")
def _(t):
    return X.filter_in(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_linenumber", [3, "chr3"])


@query("flt_14_first_by_key", """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders
  WHERE o_custkey IS NOT NULL) q WHERE r = 1""", num="o_custkey o_orderkey")
def _(t):
    first = X.first_by_key(t.orders, "o_custkey", [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()])
    return first.select("o_custkey", "o_orderkey", "o_orderpriority")


@query("flt_15_drop_text_header", """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id
  ORDER BY event_id) AS ordinal, CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS v
  FROM events) SELECT * FROM r WHERE NOT (ordinal = 1 AND try_cast(v AS DOUBLE) IS NULL)""", num="user_id ordinal")
def _(t):
    from rankloom.operators.ordering import grouped_rank
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    rows = grouped_rank(t.events.select("user_id", "event_id", v.alias("v")), ["user_id"],
                        [F.col("event_id").asc()], "ordinal")
    return X.drop_text_header(rows, "ordinal", "v").select("user_id", "ordinal", "v")


@query("flt_16_valid_symbols", """SELECT p_partkey, sym FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '?'
  WHEN p_size % 4 <> 1 THEN p_brand END AS sym FROM part) q WHERE sym IS NOT NULL AND sym <> '?'""", num="p_partkey")
def _(t):
    sym = F.when(F.col("p_size") % 4 == 0, "?").when(F.col("p_size") % 4 != 1, F.col("p_brand"))
    return X.valid_symbols(t.part.select("p_partkey", sym.alias("sym")), "sym")


@query("flt_17_canonical_columns", """SELECT l_suppkey AS sample, l_linenumber AS chromosome, l_quantity AS num_probes,
  l_discount AS segment_mean FROM lineitem""", dbl="num_probes segment_mean", num="sample chromosome")
def _(t):
    raw = t.lineitem.select(F.col("l_suppkey").alias(" Sample_ID"), F.col("l_linenumber").alias("Chromosome "),
                            F.col("l_quantity").alias("Num_Probes"), F.col("l_discount").alias("Segment_Mean"))
    return X.canonical_columns(raw, {"sample_id": "sample"})


@query("flt_18_pick_column", "SELECT o_orderpriority AS picked, count(*) AS n FROM orders GROUP BY 1", num="n")
def _(t):
    name = X.pick_column(t.orders, ["priority", "O_OrderPriority", "o_orderstatus"])
    return t.orders.groupBy(F.col(name).alias("picked")).agg(F.count("*").alias("n"))


@query("flt_19_transpose", """SELECT event_type AS sample, max(CASE WHEN m = 0 THEN v END) AS m0,
  max(CASE WHEN m = 1 THEN v END) AS m1, max(CASE WHEN m = 2 THEN v END) AS m2
  FROM (SELECT event_type, user_id % 3 AS m, max(value) AS v FROM events GROUP BY 1, 2) q GROUP BY event_type""",
       dbl="m0 m1 m2")
def _(t):
    types = ["click", "error", "purchase", "signup", "view"]
    wide = (t.events.groupBy(F.concat(F.lit("m"), F.col("user_id") % 3).alias("variable"))
            .pivot("event_type", types).agg(F.max("value")))
    return X.transpose(wide, "variable", ["m0", "m1", "m2"])


@query("flt_20_extract_measure", """SELECT event_type AS sample, max(value) AS value FROM events
  WHERE user_id = (SELECT min(user_id) FROM events WHERE upper('jak' || user_id || '|x') LIKE 'JAK1%') GROUP BY event_type""",
       dbl="value")
def _(t):
    types = ["click", "error", "purchase", "signup", "view"]
    wide = (t.events.groupBy("user_id").pivot("event_type", types).agg(F.max("value"))
            .withColumn("name", F.concat(F.lit("jak"), F.col("user_id"), F.lit("|x"))))
    return X.extract_measure(wide, "JAK1", "name", "user_id").where("value is not null")


@query("flt_21_find_ids", """SELECT DISTINCT upper(substr(v, 1, 12)) AS id FROM (
  SELECT unnest([p_name, p_brand, p_type]) AS v FROM part) q WHERE regexp_matches(v, '^Brand#1[0-9]')""")
def _(t):
    return X.find_ids(t.part.select("p_name", "p_brand", "p_type", "p_size"), "^Brand#1[0-9]")


@query("flt_22_reorder_items", """WITH p AS (SELECT p_partkey AS i, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1
  AS rk FROM part WHERE p_type = 'ECONOMY') SELECT p_partkey AS i, row_number() OVER (ORDER BY rk NULLS LAST, p_partkey) - 1
  AS pos FROM part LEFT JOIN p ON p.i = p_partkey""", num="i pos")
def _(t):
    from rankloom.operators.ordering import grouped_rank
    items = t.part.select(F.col("p_partkey").alias("i"), F.col("p_partkey").alias("pos"))
    front = grouped_rank(t.part.where("p_type = 'ECONOMY'"), [],
                         [F.col("p_retailprice").desc(), F.col("p_partkey").asc()], "pos")
    return X.reorder_items(items, front.select(F.col("p_partkey").alias("i"), "pos"))


@query("flt_23_observed_positions", f"""WITH {SCORED}, r AS (SELECT g, i, y, dense_rank() OVER (ORDER BY g) - 1 AS row,
  dense_rank() OVER (ORDER BY i) - 1 AS col FROM scored) SELECT row, col FROM r WHERE y IS NOT NULL""", num="row col")
def _(t):
    return X.observed_positions(scored(t).select("g", "i", "y"))


@query("flt_24_observed_index_array", f"""WITH {SCORED}, r AS (SELECT g, i, y, dense_rank() OVER (ORDER BY i) - 1 AS idx
  FROM scored), o AS (SELECT g, idx, row_number() OVER (PARTITION BY g ORDER BY idx) - 1 AS slot FROM r WHERE y IS NOT NULL),
  p AS (SELECT g, slot // 64 AS segment, list(idx ORDER BY idx) AS a FROM o GROUP BY 1, 2)
  SELECT g, segment, array_to_string(a, ',') || repeat(',-1', 64 - len(a)) AS indices FROM p""",
       num="g segment")
def _(t):
    arr = X.observed_index_array(scored(t).select("g", "i", "y"), width=64)
    return arr.select("g", "segment", F.array_join(F.transform("indices", lambda v: v.cast("string")), ",").alias("indices"))


_LONG = f"""WITH {RANKED_RUNS}, per AS (SELECT method, fold, g, k AS rank_k,
  sum(CASE WHEN rs <= k THEN {GAIN} / log2(rs + 1) END) / nullif(sum(CASE WHEN ry <= k THEN {GAIN} / log2(ry + 1) END), 0) AS ndcg,
  count(CASE WHEN rs <= k AND ry <= k THEN 1 END) / least(k, max(n))::DOUBLE AS precision
  FROM ranked, (VALUES (1), (5)) ks(k) GROUP BY method, fold, g, k)"""


@query("flt_25_results_long", f"""{_LONG} SELECT method, fold / 10.0 * 100 AS ratio, rank_k, avg(ndcg) AS ndcg,
  avg(precision) AS precision FROM per WHERE method IN ('A', 'R') GROUP BY method, fold, rank_k""",
       dbl="ratio ndcg precision", num="rank_k")
def _(t):
    per = M.cutoff_metrics(scored_runs(t), [1, 5], ["method", "fold", "g"])
    wide = per.groupBy("method", (F.col("fold") / 10.0).alias("ratio")).agg(
        *[F.avg(c).alias(c) for c in ("ndcg_1", "precision_1", "ndcg_5", "precision_5")])
    return X.results_long(wide, ["method", "ratio"], [1, 5], methods=["A", "R"],
                          ratio_transform=lambda c: c * 100)


udf_04_sql = f"""{_LONG} SELECT method, 1 - fold / 10.0 AS ratio, rank_k, avg(ndcg) AS ndcg, avg(precision) AS precision
  FROM per GROUP BY method, fold, rank_k"""


@query("udf_04_ratio_transform", udf_04_sql, dbl="ratio ndcg precision", num="rank_k")
def _(t):
    per = M.cutoff_metrics(scored_runs(t), [1, 5], ["method", "fold", "g"])
    wide = per.groupBy("method", (F.col("fold") / 10.0).alias("ratio")).agg(
        *[F.avg(c).alias(c) for c in ("ndcg_1", "precision_1", "ndcg_5", "precision_5")])
    return X.results_long(wide, ["method", "ratio"], [1, 5], ratio_transform=lambda c: 1 - c)


@query("flt_26_fill_labels", f"""WITH {SCORED} SELECT a.g, b.i, coalesce(y, 0) AS y FROM (SELECT DISTINCT g FROM scored) a
  CROSS JOIN (SELECT DISTINCT i FROM scored) b LEFT JOIN scored s ON s.g = a.g AND s.i = b.i""", dbl="y", num="g i")
def _(t):
    return X.fill_labels(scored(t).select("g", "i", "y"))
