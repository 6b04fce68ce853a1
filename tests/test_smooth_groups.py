"""Approximate NDCG of groups that fit a task, and of those that don't."""

import numpy as np
import pytest

from rankloom.operators import smooth_rank


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(6)
    rows = [(f"g{g}", i, float(rng.integers(0, 5)), float(rng.normal() * scale))
            for g, (n, scale) in enumerate([(1, 1.0), (40, 0.01), (300, 3.0), (25, 400.0), (2, 1e6)]) for i in range(n)]
    rows += [(None, 1, 1.0, 1.0), ("g1", 77, None, 1.0), ("g1", 78, 2.0, None), ("g2", 999, -3.0, 0.5)]
    return rows, spark.createDataFrame(rows, "g string, i int, y double, s double")


def _direct(rows):
    out = {}
    for g in {r[0] for r in rows if r[0]}:
        own = [(max(y, 0.0), s) for q, _, y, s in rows if q == g and y is not None and s is not None]
        y, s = np.array(own).T
        pair = np.maximum(1 / (1 + np.exp(np.minimum(10 * (s[:, None] - s), 700))), 1e-9)
        place = 1 + pair.sum(1) - np.diag(pair)
        out[g] = ((2 ** y - 1) / np.log2(1 + place)).sum() / max(((2 ** np.sort(y)[::-1] - 1) / np.log2(np.arange(len(y)) + 2)).sum(), 1e-9)
    return out


@pytest.mark.parametrize("task_rows", [200_000, 30])
def test_approximate_ndcg_is_the_pair_sum(scored, task_rows, monkeypatch):
    rows, df = scored
    monkeypatch.setattr(smooth_rank, "TASK_ROWS", task_rows)
    got = {r.g: r.approx_ndcg for r in smooth_rank.approx_ndcg(df).collect()}
    assert got == pytest.approx(_direct(rows), abs=1e-9)


def test_rows_of_groups_cross_batches(scored):
    rows, df = scored
    pdf = df.toPandas().dropna().sort_values("g")
    pdf["y"] = pdf["y"].clip(lower=0)
    run = smooth_rank._whole_groups(["g"], "y", "s", 10.0, 1e-9, "v")
    for size in (1, 7, 1000):
        got = [p for p in run(iter([pdf.iloc[k:k + size] for k in range(0, len(pdf), size)]))]
        assert {g: v for p in got for g, v in zip(p["g"], p["v"])} == pytest.approx(_direct(rows), abs=1e-9)


def test_small_groups_take_one_shuffle(scored):
    plan = smooth_rank.approx_ndcg(scored[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
