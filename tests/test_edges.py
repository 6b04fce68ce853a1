"""Hand-made micro tables: ties, missing labels, short lists, empty cohorts."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import aggregates as A, cohort as C, filters as X, joins as J, metrics as M
from rankloom.operators import ordering as O, similarity as K, trajectory as T

SCORED = "g string, i int, y double, s double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ties_go_by_item(spark):
    df = spark.createDataFrame([("a", i, 1.0, 0.5) for i in (4, 2, 3, 1)], SCORED)
    assert rows(M.exact_rank(df, "s"), "i", "rank") == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_single_item(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 0.1)], SCORED)
    r = M.cutoff_metrics(df, [1, 5]).first()
    assert (r.ndcg_1, r.ndcg_5, r.precision_1, r.precision_5) == (1.0, 1.0, 1.0, 1.0)
    assert M.rank_of_best(df).first().position == 0


def test_all_labels_missing(spark):
    df = spark.createDataFrame([("a", 1, None, 0.1), ("a", 2, None, 0.2)], SCORED)
    r = M.cutoff_metrics(df, [2]).first()
    assert (r.dcg_2, r.ndcg_2, r.precision_2) == (0.0, None, None)
    assert M.dcg(df, 3).first().dcg == 0.0
    assert M.dcg(df, full=True).first().dcg == 0.0
    assert M.ndcg(df, full=True).first().ndcg is None


def test_zero_gain(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.1), ("a", 2, 0.0, 0.2)], SCORED)
    assert M.ndcg(df, 2).first().ndcg is None
    assert M.exact_avg_ndcg(df).first().avg_ndcg == 0.0


def test_short_group_does_not_change_others(spark):
    long = [("b", i, float(i), float(i % 3)) for i in range(6)]
    both = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 3.0, 0.0)] + long, SCORED)
    alone = spark.createDataFrame(long, SCORED)
    pick = lambda df: M.cutoff_metrics(df, [5]).where("g = 'b'").first().ndcg_5
    assert pick(both) == pick(alone)
    short = M.cutoff_metrics(both, [5]).where("g = 'a'").first()
    assert short.precision_5 == 1.0
    assert short.ndcg_5 == pytest.approx((1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)))


def test_k_zero(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0)], SCORED)
    assert M.cutoff_metrics(df, [0, 1]).first().precision_0 is None


def test_perfect_scores_and_monotone_change(spark):
    base = spark.createDataFrame([("a", i, i / 3.0, (i * 7 % 5) * 1.0) for i in range(9)], SCORED)
    assert M.ndcg(base.withColumn("s", F.col("y")), 4).first().ndcg == pytest.approx(1.0)
    one = M.ndcg(base, 4).first().ndcg
    assert M.ndcg(base.withColumn("s", F.exp("s")), 4).first().ndcg == pytest.approx(one)
    full = M.ndcg(base, full=True).first().ndcg
    assert full == pytest.approx(M.ndcg(base, 9).first().ndcg)
    assert full == pytest.approx(M.exact_avg_ndcg(base).first().avg_ndcg)
    assert M.precision_at_k(base, 9).first().precision == 1.0


def test_missing_flags_count_as_false(spark):
    df = spark.createDataFrame(
        [("a", "negative", "negative", "negative", None, True, None), ("b", None, None, None, 3.0, False, 1.0)],
        "g string, HER2 string, ER string, PR string, CHR17 double, BRCA_germline boolean, JAK2_RPPA double")
    r = {x.g: x for x in C.cohort_flags(df).collect()}
    assert r["a"].tnbc and r["a"].tnbc_mbrca and not r["a"].tnbc_jak2 and not r["a"].chr17_pos
    assert not r["b"].tnbc and r["b"].chr17_pos and not r["b"].her2_pos


def test_empty_cohort_share(spark):
    df = spark.createDataFrame([(False, True)], "c boolean, w boolean")
    assert C.cohort_share(df, "c", "w").first().share is None


def test_constant_vector(spark):
    df = spark.createDataFrame([(1, [0.1, 0.1, 0.1]), (2, [1.0, 2.0, 4.0])], "g int, x array<double>")
    zero = {(r.g1, r.g2): r.k for r in K.pearson_pairs(df).collect()}
    assert zero[1, 2] == 0.0 and zero[2, 2] == pytest.approx(1.0)
    null = {(r.g1, r.g2): r.k for r in K.pearson_pairs(df, zero_std="null").collect()}
    assert null[1, 2] is None and null[2, 1] is None and null[1, 1] is None and len(null) == 4


def test_duplicate_keys_fan_out(spark):
    a = spark.createDataFrame([(1, 0)], "id int, pos int")
    b = spark.createDataFrame([(1, 0), (1, 1)], "id int, pos int")
    assert J.intersect_index(a, b).count() == 2
    src = b.withColumnRenamed("pos", "v")
    assert J.assemble(a.select("id"), [src], "id").count() == 2
    assert J.assemble(a.select("id"), [src], "id", dedup=True).first().v == 0


def test_zero_weight(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", None, 2.0), ("c", 3.0, 2.0)], "g string, v double, w double")
    assert rows(A.weighted_mean(df, "v", "w", ["g"]).na.fill(-9.0), "g", "wmean") == [("a", -9.0), ("b", -9.0), ("c", 3.0)]


def test_names_and_barcodes(spark):
    df = spark.createDataFrame([("X22RV1",), ("xyx",), (" A549 ",)], "n string")
    assert [r[0] for r in df.select(S.name_key("n")).collect()] == ["22rv1", "y", "a549"]
    ids = spark.createDataFrame([("tcga.3c.aaau.01",), ("TCGA-3C-AALI-11",)], "id string")
    assert [r[0] for r in ids.select(S.patient_id("id")).collect()] == ["TCGA-3C-AAAU", "TCGA-3C-AALI"]
    assert X.primary_only(ids).count() == 1


def test_smiles_tokens(spark):
    df = spark.createDataFrame([("c1ccccc1",), ("CCl",), ("ccc",), ("N",), ("",)], "s string")
    got = [r[0] for r in df.select(S.smiles_tokens("s")).collect()]
    assert got == [["c", "1c", "cc", "cc", "1"], ["C", "Cl"], ["cc"], ["N"], []]


def test_pick_and_resolve_raise(spark):
    df = spark.createDataFrame([("x",)], "name string")
    assert X.pick_column(df, ["zz", "NAME"]) == "name"
    with pytest.raises(ValueError, match="zz"):
        X.pick_column(df, ["zz"])
    with pytest.raises(ValueError, match="nope"):
        J.resolve_items(df, ["X", "nope"])


def test_canonical_columns(spark):
    df = spark.createDataFrame([(1, 2)], "` Start_Position ` int, CHROM int")
    assert X.canonical_columns(df, {"start_position": "start", "chrom": "chromosome"}).columns == ["start", "chromosome"]


def test_misaligned_columns(spark):
    a = spark.createDataFrame([(1, 2)], "k int, a int")
    b = spark.createDataFrame([(1, 2)], "k int, b int")
    assert rows(J.check_aligned(a, b, "k"), "subject", "violation") == [("a", "column"), ("b", "column")]
    assert J.check_aligned(a, a, "k").count() == 0


def test_no_early_stop_without_patience(spark):
    log = spark.createDataFrame([(e, 1.0 / (e + 1)) for e in range(6)], "epoch int, test_ndcg double")
    assert T.early_stop(log, 0).count() == 6
    assert [r.epoch for r in T.early_stop(log, 2).orderBy("epoch").collect()] == [0, 1, 2]


def test_sampled_rankings_follow_the_softmax(spark):
    df = spark.createDataFrame([("a", n, s) for n, s in enumerate([0.0, 1.0, 2.0])], "g string, i int, s double")
    first = T.sample_rankings(df, 4000, 3, label=None).where("step = 0").groupBy("i").count().collect()
    total = sum(math.exp(s) for s in (0.0, 1.0, 2.0))
    for r in first:
        assert r["count"] / 4000 == pytest.approx(math.exp(r.i) / total, abs=0.03)


def test_log_prob_over_all_orders_adds_up_to_one(spark):
    import itertools
    scores = [0.3, -1.0, 2.0]
    data = [(n, t, scores[j]) for n, order in enumerate(itertools.permutations(range(3))) for t, j in enumerate(order)]
    df = spark.createDataFrame(data, "g int, step int, s double")
    per = T.ranking_log_prob(df).groupBy("g").agg(F.sum("log_prob").alias("lp"))
    assert per.agg(F.sum(F.exp("lp"))).first()[0] == pytest.approx(1.0)


def test_even_and_odd_median(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 9.0)] + [("b", 3.0), ("b", None)], "g string, v double")
    assert rows(O.exact_median(df, ["g"], "v"), "g", "median") == [("a", 2.0), ("b", 3.0)]


def test_null_groups_stay(spark):
    from rankloom.operators import ordering as O, scans
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0)], "g int, t int, v double")
    assert {(r.g, r.median) for r in O.exact_median(df, ["g"], "v").collect()} == {(None, 2.0), (1, 6.0)}
    assert {(r.g, r.median) for r in O.exact_median(df, ["g"], "v", hot_rows=1).collect()} == {(None, 2.0), (1, 6.0)}
    runs = scans.prefix_scan(df, ["g"], "t", {"r": ("sum", F.col("v"))}, chunk=1)
    assert {(r.g, r.t, r.r) for r in runs.collect()} == {(None, 0, 1.0), (None, 1, 4.0), (1, 0, 5.0), (1, 1, 12.0)}
    back = scans.discounted_suffix(df, ["g"], "t", {"r": F.col("v")}, 1.0, chunk=1)
    assert {(r.g, r.t, r.r) for r in back.collect()} == {(None, 0, 4.0), (None, 1, 3.0), (1, 0, 12.0), (1, 1, 7.0)}
    after = scans.next_value(df, ["g"], "t", {"n": "v"}, chunk=1)
    assert {(r.g, r.t, r.n) for r in after.collect()} == {(None, 0, 3.0), (None, 1, None), (1, 0, 7.0), (1, 1, None)}
    order = O.hash_rank(df.withColumn("k", F.concat_ws(":", "g", "t")), "k", 1, by=["g"])
    assert sorted(r.rn for r in order.where("g IS NULL").collect()) == [1, 2]
    ranks = O.grouped_rank(df, ["g"], [F.col("v").desc()], "r", hot_rows=1)
    assert {(r.g, r.t, r.r) for r in ranks.collect()} == {(None, 1, 1), (None, 0, 2), (1, 1, 1), (1, 0, 2)}


def test_quoted_cells(spark, tmp_path):
    from rankloom.sources import readers as R
    (tmp_path / "a.csv").write_text('top,line\n1,"p,q",3\n4,"a ""b""",\n')
    rows = R.read_delimited(spark, str(tmp_path / "a.csv"), sep=",", skip_rows=1, names=["a", "b", "c"])
    assert {tuple(r)[:2] for r in rows.where("a = '1'").collect()} == {("1", "p,q")}
    assert [r.c for r in rows.orderBy("a").collect()] == ["3", None]
    assert len(R.read_delimited(spark, str(tmp_path / "a.csv"), sep=",", skip_rows=1).columns) == 3
    (tmp_path / "t.csv").write_text('"1,5",2\n')
    (tmp_path / "i.csv").write_text('"x,y"\nz\n')
    pairs = R.read_thresholds(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"))
    assert {(r.i, r.thr) for r in pairs.collect()} == {("x,y", None), ("z", 2.0)}


def test_masked_factors_keep_cancelling_errors(spark):
    import numpy as np
    from rankloom.operators import factorisation, fit
    x = spark.createDataFrame([(1, [1.0]), (2, [-1.0])], "g int, x array<double>")
    y = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (1, 1, 1.0)], "g int, i int, y double")
    wp, wq = factorisation._start(1, 1), factorisation._start(2, 1)
    start = (spark.createDataFrame([(0, wp[0].tolist())], "pos long, w array<double>"),
             spark.createDataFrame([(i, wq[i].tolist()) for i in (0, 1)], "i int, q array<double>"))
    model = fit.fit_mf(x, y, f=1, iters=1, lr=0.01, start=start)
    e = {(g, i): 1.0 - (v * wp[0, 0] * wq[i, 0] + 1.0) for g, v in ((1, 1.0), (2, -1.0)) for i in (0, 1) if (g, i) != (2, 1)}
    s = np.array([[e[1, 0] - e[2, 0]], [e[1, 1]]])
    want = wp + 0.01 / 3 * (s.T @ wq)
    assert np.allclose(model.wp, want, rtol=0, atol=1e-15)
    assert np.allclose(model.wq, wq + 0.01 / 3 * (s @ want), rtol=0, atol=1e-15)


def test_masked_factors_with_empty_tasks(spark):
    from rankloom.operators import fit
    x = spark.createDataFrame([(g, [0.0]) for g in range(3)], "g int, x array<double>").repartition(16)
    y = spark.createDataFrame([(g, g % 2, 1.0) for g in range(3)], "g int, i int, y double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert fit.fit_mf(x, y, f=1, iters=2).history[-1][1] < 1e-9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_tuning_judges_all_points_on_the_same_rows(spark):
    from rankloom.operators import fit
    x = spark.createDataFrame([(g, [float(g)]) for g in range(4)], "g int, x array<double>")
    y = spark.createDataFrame([(g, i, float(g + i)) for g in range(4) for i in range(3)], "g int, i int, y double")
    split = spark.createDataFrame([(g, g == 3) for g in range(4)], "g int, is_val boolean")

    def models(x, y):  # the second point has no model of item 2, which is best
        return spark.createDataFrame([(i, p, 0.1, 0.0, float(i), [0.0]) for p in (0, 1) for i in range(3) if (p, i) != (1, 2)],
                                     "i int, grid int, alpha double, l1 double, intercept double, coef array<double>")

    scores = {r.grid: r.val_ndcg for r in fit.tune(x, y, split, models, 3).collect()}
    assert scores[0] == 1.0 and scores[1] < 0.9
