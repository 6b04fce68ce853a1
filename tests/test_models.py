"""Fits and the approximate rank against direct numpy solutions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import factorisation, fit, similarity as K, smooth_rank, tuning, wide


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    y = x @ rng.normal(size=(6, 5)) + 0.1 * rng.normal(size=(40, 5))
    y[rng.random(y.shape) < 0.2] = np.nan
    xs = spark.createDataFrame([(g, v.tolist()) for g, v in enumerate(x)], "g int, x array<double>")
    ys = spark.createDataFrame([(g, i, float(y[g, i])) for g in range(40) for i in range(5) if not np.isnan(y[g, i])],
                               "g int, i int, y double")
    return x, y, xs, ys


def test_elastic_net_meets_its_optimality_conditions(data):
    x, y, xs, ys = data
    for r in fit.fit_en(xs, ys, [0.05, 0.5], [0.3, 0.9], tol=1e-10).collect():
        seen = ~np.isnan(y[:, r.i])
        a, b, w = x[seen], y[seen, r.i], np.array(r.coef)
        res = b - a @ w - r.intercept
        assert abs(res.sum()) < 1e-6
        grad = a.T @ res / seen.sum() - r.alpha * (1 - r.l1) * w
        on = w != 0
        assert np.allclose(grad[on], r.alpha * r.l1 * np.sign(w[on]), atol=1e-6)
        assert (np.abs(grad[~on]) <= r.alpha * r.l1 + 1e-6).all()


@pytest.mark.parametrize("size, added", [(16 << 20, 64), (8 * 6 * 3, 1)])
def test_wide_elastic_net_is_the_elastic_net(data, size, added, monkeypatch):
    """In one block, and in blocks of three groups and items with one feature added a round."""
    x, y, xs, ys = data
    monkeypatch.setattr(wide, "TILE_BYTES", size)
    monkeypatch.setattr(wide, "ADDED", added)
    plain = {r.i: r for r in fit.fit_en(xs, ys, [0.3], [0.6], tol=1e-12, sweeps=20_000).collect()}
    models = wide.fit_en_wide(xs, ys, 0.3, 0.6, tol=1e-12)
    found = {r.i: r for r in models.collect()}
    assert set(found) == set(plain)
    for i, r in found.items():
        coef = np.zeros(6)
        coef[r.feats] = r.coef
        assert r.intercept == pytest.approx(plain[i].intercept, abs=1e-5) and coef == pytest.approx(np.array(plain[i].coef), abs=1e-5)
    assert any(0 < len(r.feats) < 6 for r in found.values())
    want = {(r.g, r.i): r.s for r in fit.predict_linear(ys, xs, fit.fit_en(xs, ys, [0.3], [0.6], tol=1e-12, sweeps=20_000)).collect()}
    assert {(r.g, r.i): r.s for r in wide.predict_sparse(ys, xs, models).collect()} == pytest.approx(want, abs=1e-4)


def test_wide_fits_of_few_or_no_labels(data):
    _, _, xs, ys = data
    assert wide.fit_en_wide(xs, ys, 0.3, 0.6, min_samples=1000).count() == 0
    assert wide.fit_en_wide(xs, ys.where("false"), 0.3, 0.6).count() == 0
    flat = wide.fit_en_wide(xs, ys, 1e6, 0.6).collect()  # no feature is worth its penalty
    assert len(flat) == 5 and all(r.feats == [] for r in flat)
    with pytest.raises(ValueError):
        wide.fit_en_wide(xs, ys, 0.3, 0.0)


def test_kernel_ridge_equals_the_kernel_solution(data):
    x, y, xs, ys = data
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True) / np.sqrt(x.shape[1])
    k = z @ z.T
    got = fit.predict_linear(ys, K.standardised(xs), fit.fit_krr(xs, ys, [0.7])).collect()
    for r in got:
        seen = ~np.isnan(y[:, r.i])
        dual = np.linalg.solve(k[np.ix_(seen, seen)] + 0.7 * np.eye(seen.sum()), y[seen, r.i])
        assert r.s == pytest.approx(k[r.g, seen] @ dual, abs=1e-9)


def test_few_labels_give_no_model(data):
    _, _, xs, ys = data
    assert fit.fit_krr(xs, ys, [1.0], min_samples=1000).count() == 0
    assert fit.predict_linear(ys, xs, fit.fit_krr(xs, ys, [1.0], min_samples=1000)).where("s is not null").count() == 0


def _direct(x, r, f, iters, lr, mask):
    seen = ~np.isnan(r) if mask else np.ones(r.shape, bool)
    r = np.where(np.isnan(r), 0.0, r)
    n, m = r.shape
    count = seen.sum()
    mu = r[seen].sum() / count
    bp, bq = (np.zeros(n), np.zeros(m)) if mask else (r.mean(1), r.mean(0))
    wp, wq = factorisation._start(x.shape[1], f), factorisation._start(m, f)
    for _ in range(iters):
        e = np.where(seen, r - (x @ wp @ wq.T + mu + bq + bp[:, None]), 0.0)
        rmse = np.sqrt((e * e).sum() / count)
        bp, bq = bp + lr * e.sum(1) / count, bq + lr * e.sum(0) / count
        wp = wp + lr * x.T @ e @ wq / count
        wq = wq + lr * e.T @ (x @ wp) / count
    return wp, wq, bp, bq, rmse


def _starts(spark, d, m, f):
    return (spark.createDataFrame([(n, w.tolist()) for n, w in enumerate(factorisation._start(d, f))], "pos long, w array<double>"),
            spark.createDataFrame([(n, w.tolist()) for n, w in enumerate(factorisation._start(m, f))], "i int, q array<double>"))


@pytest.mark.parametrize("mask", [True, False])
def test_a_stopped_fit_goes_on(data, tmp_path, mask, monkeypatch):
    """The steps recorded before a failure are used, and the tables are those of an undisturbed fit."""
    _, _, xs, ys = data
    fitted = lambda folder: fit.fit_mf(xs, ys, 2, 5, lr=0.2, mask=mask, report_every=2, blocks=(16, 2, 4), state=folder, with_ndcg=mask)
    whole = fitted(str(tmp_path / "whole"))
    record = factorisation._Steps.record

    def stops(self, step, *rest):
        record(self, step, *rest)
        if step == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(factorisation._Steps, "record", stops)
    with pytest.raises(RuntimeError):
        fitted(str(tmp_path / "part"))
    monkeypatch.setattr(factorisation._Steps, "record", record)
    again = fitted(str(tmp_path / "part"))
    done = fitted(str(tmp_path / "part"))
    for other in (again, done):
        assert (other.wp == whole.wp).all() and (other.wq == whole.wq).all() and (other.bq == whole.bq).all()
        assert other.bias.orderBy("g").collect() == whole.bias.orderBy("g").collect()
        assert [h[1] for h in other.history] == pytest.approx([h[1] for h in whole.history])
    assert [h[0] for h in whole.history] == [0, 2, 4] and (not mask or all(0 < h[2] <= 1 for h in whole.history))


def test_fixed_projection(data):
    x, y, xs, ys = data
    model = fit.fit_mf(xs, ys, 6, 2, lr=0.2, fixed=True, blocks=(16, 2, 4))
    assert (model.wp == np.eye(6)).all() and model.history[1][1] < model.history[0][1]
    with pytest.raises(ValueError):
        fit.fit_mf(xs, ys, 3, 2, fixed=True)


@pytest.mark.parametrize("mask,iters,dim", [(False, 60, 1024), (False, 3, 0), (True, 4, 1024)])
def test_factorisation_follows_the_full_gradient(data, mask, iters, dim, monkeypatch):
    x, y, xs, ys = data
    monkeypatch.setattr(factorisation, "MOMENT_DIM", dim)
    model = fit.fit_mf(xs, ys, 3, iters, lr=0.2, mask=mask, report_every=20, blocks=(16, 2, 4), start=_starts(xs.sparkSession, 6, 5, 3))
    wp, wq, bp, bq, rmse = _direct(x, y, 3, iters, 0.2, mask)
    assert np.allclose(model.wp, wp) and np.allclose(model.wq, wq) and np.allclose(model.bq, bq)
    assert model.history[-1][1] == pytest.approx(rmse)
    assert {r.g: r.b_g for r in model.bias.collect()} == pytest.approx(dict(enumerate(bp)))
    one = fit.mf_tables(model, xs, ys).where("g = 3 and i = 2").collect()
    if one:
        assert one[0].s == pytest.approx((x[3] @ wp @ wq[2]) + model.mu + bq[2] + bp[3])


def test_smooth_positions_match_the_pair_sum(spark):
    rng = np.random.default_rng(9)
    s = np.concatenate([rng.normal(size=60), 40 * rng.random(40), np.full(20, 1.25)])
    df = spark.createDataFrame([("a", n, float(v)) for n, v in enumerate(s)], "g string, i int, s double")
    gap = np.clip(10.0 * (s[:, None] - s[None, :]), -700, 700)
    pair = np.maximum(1 / (1 + np.exp(gap)), 1e-9)
    np.fill_diagonal(pair, 0.0)
    for r in smooth_rank.smooth_positions(df).collect():
        assert r.pos == pytest.approx(1 + pair[r.i].sum(), rel=1e-7)


def test_median_gamma_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(37, 4))
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "g int, x array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert K.median_gamma(df, block=10).first().gamma == pytest.approx(1 / np.median(d))


def test_blocks_do_not_change_a_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(23, 5))
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "g int, x array<double>")
    want = np.corrcoef(x)
    for block in (4, 100):
        got = K.pearson_pairs(df, block=block).collect()
        assert len(got) == 23 * 23
        assert all(r.k == pytest.approx(want[r.g1, r.g2], abs=1e-12) for r in got)


def test_network_scores_by_hand(spark):
    from rankloom.operators.scoring import score_deep_cross
    xs = spark.createDataFrame([(1, [1.0, 2.0])], "g int, x array<double>")
    items = spark.createDataFrame([(7, [3.0])], "i int, q array<double>")
    pairs = spark.createDataFrame([(1, 7)], "g int, i int")
    weights = {"cell": np.array([[1.0], [0.5]]), "deep": [np.array([[1.0], [-2.0], [1.0]]), np.array([[2.0]])],
               "cross": [(np.array([1.0, 0.0, 0.0]), np.array([0.0, 1.0, 0.0]))], "norm": None,
               "out": (np.array([1.0, 1.0, 1.0, 1.0, 1.0]), 10.0)}
    # p = 2, q = 3, match = 6, base = (2, 3, 6); deep = relu(2 - 6 + 6) * 2 = 4
    # cross = base * 2 + (0, 1, 0) + base = (6, 10, 18); sum = 4 + 34 + 6 + 10
    assert score_deep_cross(pairs, xs, items, weights).first().s == pytest.approx(54.0)


def test_nested_tuning_of_wide_vectors_and_lost_pairs(data, spark, monkeypatch):
    _, _, xs, ys = data
    split = xs.select("g", (F.col("g") % 4 == 0).alias("is_val"))
    judge = lambda: {r.grid: (r.alpha, r.l1, r.val_ndcg, r.is_best) for r in tuning.tune_en(xs, ys, split, [0.1, 0.5], [0.5], tol=1e-11).collect()}
    plain = judge()
    monkeypatch.setattr(fit, "MAX_DIM", 5)
    assert set(plain) == {0, 1} and sum(p[3] for p in plain.values()) == 1
    for grid, point in judge().items():
        assert point == pytest.approx(plain[grid], abs=1e-9)
    scaled = tuning.scale_vectors(xs, split.where("not is_val")).toPandas().set_index("g")["x"]
    inner = np.array([scaled[g] for g in range(40) if g % 4])
    assert np.allclose(inner.mean(0), 0) and np.allclose(inner.std(0), 1) and not np.allclose(scaled[0], 0)
    pairs = K.pearson_pairs(xs).where("g1 <> 3 or g2 <> 5")
    with pytest.raises(Exception, match="lacks kernel values"):
        tuning.kernel_columns(pairs, split.where("not is_val")).collect()
    assert tuning.tune_en(xs, ys.where("false"), split, [0.1], [0.5]).count() == 0


def test_conjugate_gradients_are_the_kernel_solution(data, spark, monkeypatch):
    _, _, xs, ys = data
    kernel, some = K.rbf_pairs(xs, None, 0.05), ys.where("i < 2 and (i = 0 or g < 20)")
    fits = lambda: {(r.i, r.grid, r.t): r.w for r in fit.fit_krr_kernel(kernel, some, [20.0, 60.0]).collect()}
    plain = fits()
    monkeypatch.setattr(fit, "DUAL_LABELS", 20)  # one item has more
    assert fits() == pytest.approx(plain, abs=1e-9)
    assert fit.fit_krr_hot(kernel, some, [20.0], min_samples=1000).count() == 0
