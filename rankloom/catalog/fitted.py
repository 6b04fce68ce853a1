"""Fitted models.  Iterative fits have no SQL, but their optimality conditions have; tests check them
against direct solutions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rankloom.catalog.fixtures import SCORED, scored, vectors
from rankloom.catalog.registry import query
from rankloom.operators import fit, splits, tuning
from rankloom.operators.blocks import block_product
from rankloom.operators.metrics import ndcg
from rankloom.operators.scoring import score_deep_cross
from rankloom.operators.similarity import pearson_pairs
from rankloom.operators.surrogate import rank_surrogate, surrogate_gradient
from rankloom.operators.wide import fit_en_wide, predict_sparse
from rankloom.runtime import written


def _xy(t):
    """Samples with a label per embedding dimension group: suppliers carry the vectors."""
    x = vectors(t).join(t.supplier.select(F.col("s_suppkey").alias("g")), "g", "left_semi")
    return x, scored(t).select("g", "i", "y")


@query("fit_04_elastic_net")
def _(t):
    x, y = _xy(t)
    models = fit.fit_en(x, y.where("g % 5 <> 0"), [0.05], [0.5])
    return fit.predict_linear(y.where("g % 5 = 0"), x, models).select("g", "i", "y", "s")


@query("fit_05_kernel_ridge")
def _(t):
    from rankloom.operators.similarity import standardised
    x, y = _xy(t)
    models = fit.fit_krr(x, y.where("g % 5 <> 0"), [1.0])
    return fit.predict_linear(y.where("g % 5 = 0"), standardised(x), models).select("g", "i", "y", "s")


_LABELS = f"WITH {SCORED} SELECT i, count(y) AS n, true AS optimal FROM scored WHERE y IS NOT NULL GROUP BY i HAVING count(y) >= 5"


@query("fit_05_given_kernel", _LABELS, num="i n")
def _(t):
    """Ridge on an RBF kernel table: K a + alpha a = y holds for every item."""
    from rankloom.operators.joins import kernel_predict
    from rankloom.operators.similarity import rbf_pairs
    x, y = _xy(t)
    kernel = rbf_pairs(x, None, 0.05)
    weights = fit.fit_krr_kernel(kernel, y, [0.5])
    fitted = kernel_predict(kernel.select(F.col("g1").alias("g"), F.col("g2").alias("t"), "k"), weights.select("t", "i", "w"))
    rest = (y.where("y IS NOT NULL").join(fitted, ["g", "i"])
            .join(weights.select(F.col("t").alias("g"), "i", "w", "alpha"), ["g", "i"]))
    return rest.groupBy("i").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("s") + F.col("alpha") * F.col("w") - F.col("y"))) < 1e-8).alias("optimal"))


@query("fit_04_optimal", _LABELS, num="i n")
def _(t):
    """Elastic net: every coefficient satisfies the optimality conditions on the data."""
    x, y = _xy(t)
    alpha, l1 = 0.05, 0.5
    models = written(fit.fit_en(x, y, [alpha], [l1], sweeps=20_000, tol=1e-9))
    seen = fit.predict_linear(y.where("y IS NOT NULL"), x, models).where("s IS NOT NULL").select("g", "i", (F.col("y") - F.col("s")).alias("e"))
    gap = lambda slope, w: F.when(w == 0, F.greatest(F.abs(slope) - alpha * l1, F.lit(0.0))).otherwise(
        F.abs(slope - alpha * (1 - l1) * w - alpha * l1 * F.signum(w)))
    return fit.mean_slopes(seen, x).join(models.select("i", "coef"), "i").select(
        "i", "n", ((F.array_max(F.zip_with("slopes", "coef", gap)) < 1e-6) & (F.abs("centre") < 1e-8)).alias("optimal"))


_WIDE_LABELS = """SELECT i, count(*) AS n, true AS optimal FROM (SELECT l_suppkey AS g, l_partkey % 40 AS i FROM lineitem
  WHERE l_suppkey IN (SELECT vec_id FROM embeddings) GROUP BY 1, 2) GROUP BY i HAVING count(*) >= 5"""


@query("fit_04_wide_optimal", _WIDE_LABELS, num="i n")
def _(t):
    """Elastic net over 10,000 features a row: every coefficient satisfies the optimality conditions."""
    at = lambda j, step: F.element_at("x", (F.floor(j / step) % 64 + 1).cast("int"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda j: at(j, 1) * at(j, 64) * (64 + j / 1000) + at(j, 4096))
    y = t.lineitem.groupBy(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 40).alias("i")).agg(F.avg("l_quantity").alias("y"))
    x = written(vectors(t).join(y.select("g"), "g", "left_semi").select("g", wide.alias("x")))
    alpha, l1 = 30 / x.count() ** 0.5, 0.5  # slopes of noise fall with the root of the samples
    models = written(fit_en_wide(x, y, alpha, l1))
    seen = written(predict_sparse(y, x, models).where("s IS NOT NULL").select("g", "i", (F.col("y") - F.col("s")).alias("e")))
    slopes = block_product(x.select("g", F.posexplode("x").alias("f", "v")), seen, "f", "g", "i", "v", "e", "slope")
    sizes = seen.groupBy("i").agg(F.count("*").alias("n"), F.abs(F.avg("e")).alias("centre"))
    coefs = models.select("i", F.explode(F.arrays_zip("feats", "coef")).alias("p")).select("i", F.col("p.feats").alias("f"), F.col("p.coef").alias("w"))
    slope = F.col("slope") / F.col("n")
    gap = F.when(F.col("w").isNull(), F.abs(slope) - alpha * l1).otherwise(F.abs(slope - alpha * (1 - l1) * F.col("w") - alpha * l1 * F.signum("w")))
    return slopes.join(sizes, "i").join(coefs, ["f", "i"], "left").groupBy("i").agg(
        F.max("n").alias("n"), ((F.max(gap) < 1e-5) & (F.max("centre") < 1e-8)).alias("optimal"))


@query("fit_06_tune_elastic_net")
def _(t):
    x, y = _xy(t)
    split = splits.holdout(x.select("g"), 0.2, 5)
    return fit.tune(x, y, split, lambda a, b: fit.fit_en(a, b, [0.01, 0.1, 1.0], [0.2, 0.8]), 10)


@query("fit_06_tune_kernel_ridge")
def _(t):
    x, y = _xy(t)
    split = splits.holdout(x.select("g"), 0.2, 5)
    return fit.tune(x, y, split, lambda a, b: fit.fit_krr(a, b, [0.1, 1.0, 10.0]), 10, kernel=True)


# Twelve groups with vectors, of which every fourth is held out, and labels that miss some items.
def _nested(t):
    x = vectors(t).where("g < 12")
    y = t.lineitem.groupBy((F.col("l_orderkey") % 12).alias("g"), (F.col("l_partkey") % 30).alias("i")).agg((F.avg("l_quantity") / 10).alias("y"))
    y = y.withColumn("y", F.when((F.col("g") + F.col("i")) % 7 != 0, F.col("y")))
    return x, y, x.select("g", (F.col("g") % 4 == 3).alias("is_val"))


_NESTED = """vec AS MATERIALIZED (SELECT vec_id AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 12),
  lab AS MATERIALIZED (SELECT l_orderkey % 12 AS g, l_partkey % 30 AS i, CASE WHEN (l_orderkey % 12 + l_partkey % 30) % 7 <> 0 THEN avg(l_quantity) / 10 END AS y
    FROM lineitem GROUP BY 1, 2)"""
_KERNEL = """ker AS (SELECT a.g AS g1, b.g AS g2, (list_dot_product(a.v, b.v) / len(a.v) - list_avg(a.v) * list_avg(b.v)) / (list_stddev_pop(a.v) * list_stddev_pop(b.v)) AS k
    FROM vec AS a, vec AS b), raw AS MATERIALIZED (SELECT g1 AS g, list(k ORDER BY g2) AS x FROM ker WHERE g2 % 4 <> 3 GROUP BY g1)"""


def _judged_sql(points: str, scores: str) -> str:
    """Mean NDCG@10 of the held-out groups for every grid point."""
    return f"""sc AS (SELECT lab.g, lab.i, y, grid, alpha, l1, s FROM lab CROSS JOIN ({points}) AS p LEFT JOIN ({scores}) AS f USING (g, i, grid) WHERE lab.g % 4 = 3),
  rk AS (SELECT *, row_number() OVER (PARTITION BY grid, g ORDER BY s DESC NULLS LAST, i) AS rs, row_number() OVER (PARTITION BY grid, g ORDER BY y DESC, i) AS ry
    FROM sc WHERE y IS NOT NULL),
  per AS (SELECT grid, alpha, l1, g, sum(CASE WHEN rs <= 10 THEN (pow(2, y) - 1) / log2(rs + 1) END) / sum(CASE WHEN ry <= 10 THEN (pow(2, y) - 1) / log2(ry + 1) END) AS n
    FROM rk GROUP BY ALL)
  SELECT grid, alpha, l1, avg(n) AS val_ndcg, row_number() OVER (ORDER BY avg(n) DESC, grid) = 1 AS is_best FROM per GROUP BY grid, alpha, l1"""


def _points(alphas, l1s=(0.0,)) -> str:
    values = ", ".join(f"({n}, CAST({a} AS DOUBLE), CAST({l} AS DOUBLE))" for n, (a, l) in enumerate((a, l) for a in alphas for l in l1s))
    return f"SELECT * FROM (VALUES {values}) AS v(grid, alpha, l1)"


def _nested_net_sql(d: int, raw: str, alphas, l1s, steps: int = 3000) -> str:
    """The elastic net by proximal gradient steps on the moments of the inner groups."""
    f = range(1, d + 1)
    each = lambda text: "[" + ", ".join(text.format(j=j) for j in f) + "]"
    gram = "[" + ", ".join(f"avg(x[{j}] * x[{k}]) - avg(x[{j}]) * avg(x[{k}])" for j in f for k in f) + "]"
    slope = f"c[j] - list_dot_product(gram[(j - 1) * {d} + 1 : j * {d}], w) - alpha * (1 - l1) * w[j]"
    return f"""WITH RECURSIVE {_NESTED}, {raw},
  st AS (SELECT {each("avg(x[{j}])")} AS m, {each("CASE WHEN stddev_pop(x[{j}]) = 0 THEN 1 ELSE stddev_pop(x[{j}]) END")} AS sd FROM raw WHERE g % 4 <> 3),
  z AS MATERIALIZED (SELECT g, {each("(x[{j}] - m[{j}]) / sd[{j}]")} AS x FROM raw, st),
  mo AS MATERIALIZED (SELECT i, avg(y) AS my, {each("avg(x[{j}])")} AS mx, {gram} AS gram, {each("avg(x[{j}] * y) - avg(x[{j}]) * avg(y)")} AS c,
    {" + ".join(f"var_pop(x[{j}])" for j in f)} AS top FROM lab JOIN z USING (g) WHERE g % 4 <> 3 AND y IS NOT NULL GROUP BY i HAVING count(*) >= 5),
  it AS (SELECT 0 AS n, i, grid, alpha, l1, {each("CAST(0 AS DOUBLE)")} AS w FROM mo, ({_points(alphas, l1s)}) AS p
    UNION ALL SELECT n + 1, i, grid, alpha, l1, [sign(u) * greatest(abs(u) - alpha * l1 / (top + alpha), 0) FOR u IN [w[j] + ({slope}) / (top + alpha) FOR j IN range(1, {d + 1})]]
    FROM it JOIN mo USING (i) WHERE n < {steps}),
  {_judged_sql(_points(alphas, l1s), f"SELECT z.g, i, grid, my + list_dot_product(w, x) - list_dot_product(w, mx) AS s FROM it JOIN mo USING (i), z WHERE n = {steps}")}"""


def _nested_ridge_sql(d: int, alphas, steps: int = 600) -> str:
    """Kernel ridge by Richardson steps on the inner block; a group without the item's label has weight 0."""
    return f"""WITH RECURSIVE {_NESTED}, {_KERNEL},
  inner_ AS (SELECT g, x, row_number() OVER (ORDER BY g) AS r FROM raw WHERE g % 4 <> 3), k AS (SELECT flatten(list(x ORDER BY g)) AS k FROM inner_),
  mo AS MATERIALIZED (SELECT i, list(coalesce(y, 0) ORDER BY r) AS y, list(CASE WHEN y IS NULL THEN 0 ELSE 1 END ORDER BY r) AS known
    FROM (SELECT DISTINCT i FROM lab) CROSS JOIN inner_ LEFT JOIN lab USING (g, i) GROUP BY i HAVING count(y) >= 5),
  it AS (SELECT 0 AS n, i, grid, alpha, [CAST(0 AS DOUBLE) FOR j IN range({d})] AS w FROM mo, ({_points(alphas)}) AS p
    UNION ALL SELECT n + 1, i, grid, alpha, [known[j] * (w[j] + (y[j] - list_dot_product(k[(j - 1) * {d} + 1 : j * {d}], w) - alpha * w[j]) / ({d} + alpha)) FOR j IN range(1, {d + 1})]
    FROM it JOIN mo USING (i), k WHERE n < {steps}),
  {_judged_sql(_points(alphas), f"SELECT raw.g, i, grid, list_dot_product(w, x) AS s FROM it, raw WHERE n = {steps}")}"""


@query("fit_06_scaled_vectors", _nested_net_sql(5, "raw AS (SELECT g, v[1:5] AS x FROM vec)", [0.2, 0.6], [0.2, 0.6]), dbl="alpha l1 val_ndcg", num="grid")
def _(t):
    """Elastic net on vectors scaled by the inner groups."""
    x, y, split = _nested(t)
    return tuning.tune_en(x.select("g", F.slice("x", 1, 5).alias("x")), y, split, [0.2, 0.6], [0.2, 0.6], 10)


@query("fit_06_kernel_columns", _nested_net_sql(9, _KERNEL, [0.2, 0.6], [0.2, 0.6]), dbl="alpha l1 val_ndcg", num="grid")
def _(t):
    """Elastic net on the similarities to the inner groups."""
    x, y, split = _nested(t)
    return tuning.tune_en_kernel(pearson_pairs(x), y, split, [0.2, 0.6], [0.2, 0.6], 10)


@query("fit_06_kernel_ridge_inner", _nested_ridge_sql(9, [0.5, 2.0]), dbl="alpha l1 val_ndcg", num="grid")
def _(t):
    """Kernel ridge whose columns are the inner groups."""
    x, y, split = _nested(t)
    return tuning.tune_krr_kernel(pearson_pairs(x), y, split, [0.5, 2.0], 10)


@query("fit_01_mf_zero_filled")
def _(t):
    x, y = _xy(t)
    model = fit.fit_mf(x, y.where("g % 5 <> 0"), 8, 300, lr=5.0, mask=False)
    return fit.mf_tables(model, x, y.where("g % 5 = 0"))


@query("fit_02_mf_masked")
def _(t):
    x, y = _xy(t)
    model = fit.fit_mf(x, y.where("g % 5 <> 0"), 8, 3, lr=5.0)
    return fit.mf_tables(model, x, y.where("g % 5 = 0"))


def _masked_sql(steps: int, lr: float) -> str:
    """The masked gradient steps written out, one chain of tables per step."""
    f = (1, 2, 3)
    each = lambda text: "[" + ", ".join(text.format(k=k) for k in f) + "]"
    parts = [f"""WITH {SCORED}, vec AS MATERIALIZED (SELECT vec_id AS g, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IN (SELECT s_suppkey FROM supplier)),
  pairs AS MATERIALIZED (SELECT g, i, y FROM scored JOIN vec USING (g)), lab AS MATERIALIZED (SELECT * FROM pairs WHERE y IS NOT NULL),
  c AS (SELECT count(*) AS nk, avg(y) AS mu FROM lab),
  w0 AS MATERIALIZED (SELECT k, [((j * 7 + k * 3) % 11) / 110 - 0.05 FOR j IN range(64)] AS w FROM range(1, 4) AS t(k)),
  q0 AS MATERIALIZED (SELECT i, {each("((i * 5 + {k} * 3) % 13) / 130 - 0.05")} AS q, CAST(0 AS DOUBLE) AS b FROM (SELECT DISTINCT i FROM scored)),
  p0 AS MATERIALIZED (SELECT g, list(list_dot_product(x, CAST(w AS DOUBLE[])) ORDER BY k) AS p, CAST(0 AS DOUBLE) AS b FROM vec, w0 GROUP BY g)"""]
    for n in range(steps):
        parts.append(f"""e{n} AS MATERIALIZED (SELECT g, i, y - (list_dot_product(p, CAST(q AS DOUBLE[])) + mu + a.b + d.b) AS e, q FROM lab JOIN p{n} AS a USING (g) JOIN q{n} AS d USING (i), c),
  g{n} AS MATERIALIZED (SELECT g, sum(e) AS s, {each("sum(e * q[{k}])")} AS eq FROM e{n} GROUP BY g),
  d{n} AS (SELECT k, j, sum(x[j] * eq[k]) AS d FROM g{n} JOIN vec USING (g), range(1, 65) AS r(j), range(1, 4) AS t(k) GROUP BY k, j),
  w{n + 1} AS MATERIALIZED (SELECT k, list(w[j] + {lr} / nk * d ORDER BY j) AS w FROM w{n} JOIN d{n} USING (k), c GROUP BY k),
  m{n} AS (SELECT g, list(list_dot_product(x, w) ORDER BY k) AS p FROM vec, w{n + 1} GROUP BY g),
  p{n + 1} AS MATERIALIZED (SELECT g, m.p, a.b + coalesce({lr} / nk * s, 0) AS b FROM m{n} AS m JOIN p{n} AS a USING (g) LEFT JOIN g{n} USING (g), c),
  h{n} AS (SELECT i, sum(e) AS s, {each("sum(e * p[{k}])")} AS ep FROM e{n} JOIN p{n + 1} USING (g) GROUP BY i),
  q{n + 1} AS MATERIALIZED (SELECT i, {each("q[{k}] + coalesce(" + str(lr) + " / nk * ep[{k}], 0)")} AS q, b + coalesce({lr} / nk * s, 0) AS b FROM q{n} LEFT JOIN h{n} USING (i), c)""")
    return ", ".join(parts) + f""" SELECT g, i, y, list_dot_product(p, q) + mu + a.b + d.b AS s FROM pairs JOIN p{steps} AS a USING (g) JOIN q{steps} AS d USING (i), c"""


@query("fit_02_masked_steps", _masked_sql(3, 5.0), dbl="y s", num="g i")
def _(t):
    """Three masked steps from a given start."""
    x, y = _xy(t)
    f = F.sequence(F.lit(1), F.lit(3))
    wp = t.spark.range(64).select(F.col("id").alias("pos"), F.transform(f, lambda k: (F.col("pos") * 7 + k * 3) % 11 / 110 - 0.05).alias("w"))
    q = y.select("i").distinct().withColumn("q", F.transform(f, lambda k: (F.col("i") * 5 + k * 3) % 13 / 130 - 0.05))
    return fit.mf_tables(fit.fit_mf(x, y, 3, 3, lr=5.0, start=(wp, q)), x, y)


@query("fit_03_mf_tables")
def _(t):
    x, y = _xy(t)
    model = fit.fit_mf(x, y, 8, 300, lr=5.0, mask=False)
    scores = fit.mf_tables(model, x, y)
    per = ndcg(scores, 10)
    err = scores.groupBy("g").agg(F.sqrt(F.avg((F.col("s") - F.col("y")) ** 2)).alias("rmse"))
    return per.join(err, "g").join(model.group_table(x).select("g", F.size("p").alias("dim")), "g")


@query("rank_16_surrogate")
def _(t):
    rows, losses = rank_surrogate(scored(t).withColumn("s", F.col("s") / 10), 10)
    return rows.join(losses, "g")


def _kernel_features(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") % 50).alias("t")).agg(
        F.avg("l_discount").alias("x"))


def _start_weights(t):
    return t.lineitem.groupBy((F.col("l_orderkey") % 50).alias("t"), F.col("l_partkey").alias("i")).agg(
        F.avg("l_tax").alias("w"))


@query("rank_17_surrogate_gradient")
def _(t):
    grad, _ = surrogate_gradient(scored(t), _kernel_features(t), _start_weights(t), 10)
    return grad


_SQUARED = f"""WITH {SCORED}, k AS (SELECT l_suppkey AS g, l_orderkey % 50 AS t, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2),
  w AS (SELECT l_orderkey % 50 AS t, l_partkey AS i, avg(l_tax) AS w FROM lineitem GROUP BY 1, 2),
  f AS (SELECT g, i, sum(x * w) AS s FROM k JOIN w USING (t) GROUP BY g, i),
  r AS (SELECT g, i, 2 * (f.s - y) AS gradient FROM scored JOIN f USING (g, i) WHERE y IS NOT NULL)
  SELECT t, i, sum(x * gradient) AS gradient FROM r JOIN k USING (g) GROUP BY t, i"""


@query("udf_05_pluggable_loss", _SQUARED, dbl="gradient", num="t i")
def _(t):
    def squared(rows, _):
        gap = F.col("s") - F.col("y")
        seen = rows.where("y is not null")
        return (seen.withColumn("gradient", 2 * gap), seen.groupBy("g").agg(F.sum(gap * gap).alias("loss")))
    grad, _ = surrogate_gradient(scored(t), _kernel_features(t), _start_weights(t), 3, squared)
    return grad


def _network() -> dict:
    draw = np.random.default_rng(3).normal
    return {"cell": 0.2 * draw(size=(64, 4)), "deep": [0.3 * draw(size=(9, 8)), 0.3 * draw(size=(8, 4))],
            "cross": [(0.2 * draw(size=9), np.zeros(9)) for _ in range(2)],
            "norm": (np.zeros(14), np.ones(14), np.ones(14), np.zeros(14), 1e-5),
            "out": (draw(size=14), 10.0)}


_ITEM = ("p_size / 50", "p_retailprice / 2000", "p_partkey % 7 / 7", "1")


def _network_sql(w: dict) -> str:
    """The network as list products with its weights written out."""
    def dots(vector: str, matrix: np.ndarray, wrap: str = "{}") -> str:
        return "[" + ", ".join(wrap.format(f"list_dot_product({vector}, {[float(v) for v in column]})") for column in matrix.T) + "]"

    steps, last = [], "b"
    for n, (vector, _) in enumerate(w["cross"]):
        parts = ", ".join(f"b[{j}] * list_dot_product({last}, {[float(v) for v in vector]}) + {last}[{j}]" for j in range(1, 10))
        steps.append(f"c{n} AS (SELECT *, [{parts}] AS x{n} FROM {'h2' if n == 0 else f'c{n - 1}'})")
        last = f"x{n}"
    joint = f"[greatest(v, 0) / sqrt(1 + {w['norm'][4]}) FOR v IN list_concat(hidden, {last}, [m])]"
    item = ", ".join(f"CAST({e} AS DOUBLE)" for e in _ITEM)
    return f"""WITH {SCORED}, vec AS (SELECT vec_id AS g, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IN (SELECT s_suppkey FROM supplier)),
  pq AS (SELECT s.g, s.i, {dots('x', w['cell'])} AS p, [{item}] AS q FROM scored s JOIN vec USING (g) JOIN part ON p_partkey = s.i),
  b0 AS (SELECT g, i, list_dot_product(p, q) AS m, list_concat(p, q, [list_dot_product(p, q)]) AS b FROM pq),
  h1 AS (SELECT *, {dots('b', w['deep'][0], 'greatest({}, 0)')} AS h FROM b0),
  h2 AS (SELECT *, {dots('h', w['deep'][1])} AS hidden FROM h1), {', '.join(steps)}
  SELECT g, i, list_dot_product({joint}, {[float(v) for v in w['out'][0]]}) + {w['out'][1]} AS s FROM c{len(w['cross']) - 1}"""


@query("fit_08_score_deep_cross", _network_sql(_network()), dbl="s", num="g i")
def _(t):
    x, y = _xy(t)
    q = t.part.select(F.col("p_partkey").alias("i"), F.array(*[F.expr(e).cast("double") for e in _ITEM]).alias("q"))
    return score_deep_cross(y, x, q, _network())
