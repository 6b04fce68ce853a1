"""Ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import RANKED, RANKED_RUNS, SCORED, scored, scored_runs
from rankloom.catalog.registry import query
from rankloom.operators import metrics as M, ordering as O, smooth_rank
from rankloom.plans import report

GAIN = "(pow(2, y) - 1)"
KS = [1, 3, 5, 10, 20]

_DCG = """coalesce(sum(CASE WHEN rs <= {k} THEN (pow(2, y) - 1) / log2(rs + 1) END), 0) AS dcg_{k},
  coalesce(sum(CASE WHEN ry <= {k} THEN (pow(2, y) - 1) / log2(ry + 1) END), 0) AS idcg_{k},
  sum(CASE WHEN rs <= {k} THEN (pow(2, y) - 1) / log2(rs + 1) END)
    / nullif(sum(CASE WHEN ry <= {k} THEN (pow(2, y) - 1) / log2(ry + 1) END), 0) AS ndcg_{k},
  count(CASE WHEN rs <= {k} AND ry <= {k} THEN 1 END) / nullif(least({k}, max(n)), 0)::DOUBLE AS precision_{k}"""


@query("rank_01_dcg_at_k", f"""WITH {RANKED} SELECT a.g, coalesce(d, 0) AS dcg FROM (SELECT DISTINCT g FROM scored) a
  LEFT JOIN (SELECT g, sum({GAIN} / log2(rs + 1)) AS d FROM ranked WHERE rs <= 10 GROUP BY g) b USING (g)""",
       dbl="dcg", num="g")
def _(t):
    return M.dcg(scored(t), 10)


@query("rank_01_dcg_full", f"WITH {RANKED} SELECT g, sum({GAIN} / log2(rs + 1)) AS dcg FROM ranked GROUP BY g",
       dbl="dcg", num="g")
def _(t):
    return M.dcg(scored(t), full=True)


@query("rank_02_ndcg_at_k", f"""WITH {RANKED} SELECT g, sum(CASE WHEN rs <= 10 THEN {GAIN} / log2(rs + 1) END)
  / nullif(sum(CASE WHEN ry <= 10 THEN {GAIN} / log2(ry + 1) END), 0) AS ndcg FROM ranked GROUP BY g""",
       dbl="ndcg", num="g")
def _(t):
    return M.ndcg(scored(t), 10)


@query("rank_02_ndcg_full", f"""WITH {RANKED} SELECT g, sum({GAIN} / log2(rs + 1))
  / nullif(sum({GAIN} / log2(ry + 1)), 0) AS ndcg FROM ranked GROUP BY g""", dbl="ndcg", num="g")
def _(t):
    return M.ndcg(scored(t), full=True)


@query("rank_02_cutoffs_all_k",
       f"WITH {RANKED} SELECT g, " + ", ".join(_DCG.format(k=k) for k in KS) + " FROM ranked GROUP BY g",
       dbl=" ".join(f"{m}_{k}" for k in KS for m in ("dcg", "idcg", "ndcg", "precision")), num="g")
def _(t):
    return M.cutoff_metrics(scored(t), KS)


@query("rank_03_dcg_natural_log", f"""WITH {RANKED} SELECT g, sum({GAIN} / ln(rs + 1)) AS dcg
  FROM ranked WHERE rs <= 5 GROUP BY g""", dbl="dcg", num="g")
def _(t):
    return M.dcg(scored(t), 5, log="ln")


@query("rank_04_exact_avg_ndcg", f"""WITH {RANKED} SELECT avg(coalesce(v, 0)) AS avg_ndcg FROM (
  SELECT g, sum({GAIN} / ln(rs + 1)) / nullif(sum({GAIN} / ln(ry + 1)), 0) AS v FROM ranked GROUP BY g) q""",
       dbl="avg_ndcg")
def _(t):
    return M.exact_avg_ndcg(scored(t))


@query("rank_05_mean_ndcg", f"""WITH {RANKED} SELECT avg(v) AS mean_ndcg FROM (
  SELECT g, sum(CASE WHEN rs <= 5 THEN {GAIN} / log2(rs + 1) END)
  / nullif(sum(CASE WHEN ry <= 5 THEN {GAIN} / log2(ry + 1) END), 0) AS v FROM ranked GROUP BY g) q""",
       dbl="mean_ndcg")
def _(t):
    return M.mean_ndcg(scored(t), 5)


@query("rank_06_ndcg_from_position", f"""WITH {SCORED}, r AS (SELECT *, g % 3 AS p,
  row_number() OVER (PARTITION BY g ORDER BY s DESC, i) AS rs,
  row_number() OVER (PARTITION BY g ORDER BY y DESC, i) AS ry
  FROM scored WHERE y IS NOT NULL AND i % 5 <> 0)
  SELECT g, sum(CASE WHEN rs + p <= 10 THEN {GAIN} / log2(rs + p + 1) END)
  / nullif(sum(CASE WHEN ry + p <= 10 THEN {GAIN} / log2(ry + p + 1) END), 0) AS ndcg FROM r GROUP BY g""",
       dbl="ndcg", num="g")
def _(t):
    df = scored(t).withColumn("taken", F.col("i") % 5 == 0).withColumn("p", F.col("g") % 3)
    return M.ndcg_from_position(df, "taken", "p", 10)


_APPROX = f"""WITH {SCORED}, o AS (SELECT g, i, greatest(y, 0) AS y, s,
  row_number() OVER (PARTITION BY g ORDER BY y DESC, i) AS ry FROM scored WHERE y IS NOT NULL),
  pos AS (SELECT a.g, a.i, any_value(a.y) AS y,
  1 + sum(CASE WHEN b.i <> a.i THEN greatest(1 / (1 + exp(least(10 * (a.s - b.s), 700))), 1e-9) ELSE 0 END) AS p
  FROM o a JOIN o b ON a.g = b.g GROUP BY a.g, a.i),
  ideal AS (SELECT g, sum({GAIN} / log2(ry + 1)) AS best FROM o GROUP BY g),
  per AS (SELECT g, sum({GAIN} / log2(1 + p)) / greatest(any_value(best), 1e-9) AS approx_ndcg
  FROM pos JOIN ideal USING (g) GROUP BY g)"""


@query("rank_07_approx_ndcg", f"{_APPROX} SELECT g, approx_ndcg FROM per", dbl="approx_ndcg", num="g")
def _(t):
    return smooth_rank.approx_ndcg(scored(t))


@query("rank_07_approx_ndcg_loss", f"{_APPROX} SELECT -avg(approx_ndcg) AS loss FROM per", dbl="loss")
def _(t):
    return smooth_rank.approx_ndcg_loss(scored(t))


@query("rank_08_precision_at_k", f"""WITH {RANKED} SELECT g,
  count(CASE WHEN rs <= 10 AND ry <= 10 THEN 1 END) / least(10, max(n))::DOUBLE AS precision FROM ranked GROUP BY g""",
       dbl="precision", num="g")
def _(t):
    return M.precision_at_k(scored(t), 10)


@query("rank_09_rank_of_best", f"WITH {RANKED} SELECT g, rs - 1 AS position FROM ranked WHERE ry = 1",
       num="g position")
def _(t):
    return M.rank_of_best(scored(t))


@query("rank_09_rank_of_third_best", f"WITH {RANKED} SELECT g, rs - 1 AS position FROM ranked WHERE ry = 3",
       num="g position")
def _(t):
    return M.rank_of_best(scored(t), which=2)


@query("rank_10_rank_of_prediction", f"WITH {RANKED} SELECT g, ry - 1 AS position FROM ranked WHERE rs = 1",
       num="g position")
def _(t):
    return M.rank_of_prediction(scored(t))


@query("rank_11_percentiles", f"""WITH {RANKED}, w AS (SELECT DISTINCT g, which FROM scored, range(5) r(which))
  SELECT w.g, w.which, (ry - 1) / n::DOUBLE AS percentile FROM w
  LEFT JOIN ranked ON ranked.g = w.g AND rs = which + 1""", dbl="percentile", num="g which")
def _(t):
    return M.percentiles(scored(t), 5)


@query("rank_12_positions_of_label", f"""WITH {SCORED} SELECT g, i, position FROM (SELECT *,
  row_number() OVER (PARTITION BY g ORDER BY s DESC NULLS LAST, i) - 1 AS position FROM scored) q
  WHERE y = 5.0""", num="g i position")
def _(t):
    return M.positions_of_label(scored(t), 5.0)


@query("rank_13_exact_rank", f"""WITH {SCORED} SELECT g, i,
  row_number() OVER (PARTITION BY g ORDER BY s DESC, i) - 1 AS rank FROM scored""", num="g i rank")
def _(t):
    return M.exact_rank(scored(t).select("g", "i", "s"), "s").select("g", "i", "rank")


@query("rank_14_step_reward", f"WITH {RANKED} SELECT g, i, rs - 1 AS rank, {GAIN} / log2(rs + 1) AS reward FROM ranked",
       dbl="reward", num="g i rank")
def _(t):
    return M.step_reward(scored(t)).select("g", "i", "rank", "reward")


@query("rank_15_path_rewards", f"""WITH {RANKED} SELECT g, sum({GAIN} / log2(rs + 1)) AS achieved,
  sum({GAIN} / log2(ry + 1)) AS best FROM ranked GROUP BY g""", dbl="achieved best", num="g")
def _(t):
    return M.path_rewards(scored(t))


@query("win_01_ranked", f"WITH {RANKED} SELECT g, i, rs, ry FROM ranked", num="g i rs ry")
def _(t):
    return M.full_ranks(scored(t)).select("g", "i", "rs", "ry")


@query("top_01_top_k", f"WITH {RANKED} SELECT g, i, rs AS rank FROM ranked WHERE rs <= 3", num="g i rank")
def _(t):
    top = O.top_k(M.observed(scored(t)), ["g"], O.score_order("s"), 3)
    return top.select("g", "i", "rank")


_PER_RUN = f"""WITH {RANKED_RUNS}, per AS (SELECT method, fold, g, """ + ", ".join(
    _DCG.format(k=k) for k in (1, 5, 10)) + " FROM ranked GROUP BY method, fold, g)"
_WANTED = ["ndcg_1", "precision_1", "ndcg_5", "precision_5", "ndcg_10", "precision_10"]
_AVGS = ", ".join(f"avg({c}) AS {c}" for c in _WANTED)


@query("agg_10_fold_report", f"""{_PER_RUN}, folds AS (SELECT method, fold, avg(ndcg_5) AS ndcg_5 FROM per
  GROUP BY method, fold) SELECT method, avg(ndcg_5) AS ndcg_5 FROM folds GROUP BY method""", dbl="ndcg_5")
def _(t):
    per = M.cutoff_metrics(scored_runs(t), [5], ["method", "fold", "g"])
    return report.fold_report(per, ["ndcg_5"])


@query("agg_10_pooled_report", f"{_PER_RUN} SELECT method, avg(ndcg_5) AS ndcg_5 FROM per GROUP BY method",
       dbl="ndcg_5")
def _(t):
    per = M.cutoff_metrics(scored_runs(t), [5], ["method", "fold", "g"])
    return report.fold_report(per, ["ndcg_5"], foldwise=False)


@query("agg_23_evaluate", f"""{_PER_RUN} SELECT avg(ndcg_10) AS ndcg, avg(dcg_10) AS dcg, avg(idcg_10) AS idcg
  FROM per""", dbl="ndcg dcg idcg")
def _(t):
    return report.evaluate(scored_runs(t), 10, ["method", "fold", "g"])


@query("agg_24_compare_methods", f"""{_PER_RUN}, folds AS (SELECT method, fold, {_AVGS} FROM per
  GROUP BY method, fold) SELECT method, {_AVGS} FROM folds GROUP BY method""", dbl=" ".join(_WANTED))
def _(t):
    return report.compare_methods(scored_runs(t), [1, 5, 10])


@query("udf_03_metric_registry", f"""WITH {RANKED} SELECT g,
  sum(CASE WHEN rs <= 5 THEN {GAIN} / log2(rs + 1) END)
  / nullif(sum(CASE WHEN ry <= 5 THEN {GAIN} / log2(ry + 1) END), 0) AS ndcg_5,
  count(CASE WHEN rs <= 10 AND ry <= 10 THEN 1 END) / least(10, max(n))::DOUBLE AS precision_10,
  count(CASE WHEN rs <= 3 AND ry <= 1 THEN 1 END) > 0 AS hit_3 FROM ranked GROUP BY g""",
       dbl="ndcg_5 precision_10", num="g")
def _(t):
    def hit(df, k, by):
        return M.rank_of_best(df, by=by).select(*by, (F.col("position") < k).alias(f"hit_{k}"))
    return M.evaluate_metrics(scored(t), [("ndcg", 5), ("precision", 10), ("hit", 3)],
                              registry={**M.METRICS, "hit": hit})
