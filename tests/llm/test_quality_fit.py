"""Operator 10's fit against plain gradient descent and a plain cut."""
import math

import numpy as np

from fbrank.llm import quality


def _data(seed, n=400, k=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * [1, 2, 0.5, 1, 10] + [0, 3, 0, 0, 50]
    good = x @ [1.5, -0.5, 0.0, 1.0, 0.02] + rng.normal(size=n) * 0.7 > 0
    return x, good


def test_newton_finds_what_gradient_descent_finds():
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        d = rng.normal(size=(500, 4)) + [0.5, -0.2, 0.0, 0.1]
        ridge = 0.01
        w = np.zeros(4)
        for _ in range(20_000):  # the loss is smooth and convex: small steps lead to its only minimum
            p = 1 / (1 + np.exp(d @ w))
            w -= 0.5 * (-(d * p[:, None]).mean(axis=0) + ridge * w)
        assert np.allclose(quality.bradley_terry(d, ridge=ridge), w, atol=1e-6)


def test_separable_pairs_and_equal_features_have_finite_weights():
    d = np.abs(np.random.default_rng(3).normal(size=(50, 3)))
    assert np.isfinite(quality.bradley_terry(d)).all()
    assert np.allclose(quality.bradley_terry(np.zeros((20, 3))), 0)


def test_cut_is_the_quantile_of_the_rejected():
    x, good = _data(4)
    m = quality.fit(x, good)
    raw = sorted(float(v) for v in quality._wide(x, m.mean, m.scale) @ m.weights)
    rejected = int((~good).sum())
    assert math.isclose(m.cut, (raw[rejected - 1] + raw[rejected]) / 2)
    score = m.score(x)
    assert (score >= quality.KEEP).sum() == good.sum()  # as many as are labelled good
    order = np.argsort(quality._wide(x, m.mean, m.scale) @ m.weights)
    assert (np.diff(score[order]) >= 0).all() and ((score > 0) & (score < 1)).all()
    assert ((score >= quality.KEEP) == good).mean() > 0.8


def test_preferences_order_the_scores():
    x, good = _data(5)
    m = quality.fit(x, good)
    s = m.score(x)
    assert (s[good][:, None] > s[~good][None, :]).mean() > 0.9  # share of preference pairs in the right order
