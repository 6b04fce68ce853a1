"""Kernels leave their tasks in strips, whatever the number of vectors of a block."""

import numpy as np
import pytest

from rankloom.operators import similarity as K


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(2).normal(size=(57, 5))
    x[9] = x[4]
    return x, spark.createDataFrame([(f"s{g:02d}", v.tolist()) for g, v in enumerate(x)], "g string, x array<double>")


def test_no_more_than_a_strip_exists_at_a_time(vectors, monkeypatch):
    x, df = vectors
    monkeypatch.setattr(K, "STRIP_CELLS", 100)
    batches = K._met(df, None, "g", "x", 20).toArrow().to_batches()
    seen = 0
    for ids1, ids2, k, off in K._strips(iter(batches), K._sq):
        assert k.shape == (len(ids1), len(ids2)) and k.size <= 100
        seen += k.size * (2 if off else 1)
    assert seen == 57 * 57


@pytest.mark.parametrize("block", [None, 8])
def test_pairs_of_strips(vectors, block, monkeypatch):
    x, df = vectors
    monkeypatch.setattr(K, "STRIP_CELLS", 30)
    want = np.corrcoef(x)
    got = {(int(r.g1[1:]), int(r.g2[1:])): r.k for r in K.pearson_pairs(df, block=block).collect()}
    assert len(got) == 57 * 57 and all(abs(want[p] - k) < 1e-12 for p, k in got.items())
    best = {}
    for r in K.pearson_top_k(df, 3, block=block).collect():
        best.setdefault(int(r.g1[1:]), set()).add(int(r.g2[1:]))
    np.fill_diagonal(want, -2)
    order = np.lexsort((np.broadcast_to(np.arange(57), want.shape), -want.round(9)), axis=1)[:, :3]
    assert best == {g: set(o.tolist()) for g, o in enumerate(order)}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert K.median_gamma(df, block=block).first().gamma == pytest.approx(1 / np.median(d))
    few, rest = df.where("g < 's10'"), df.where("g >= 's10'")
    got = {(int(r.g1[1:]), int(r.g2[1:])): r.k for r in K.rbf_pairs(few, rest, 0.3, block=block).collect()}
    assert len(got) == 10 * 47 and all(abs(np.exp(-0.3 * d[p]) - k) < 1e-12 for p, k in got.items())
