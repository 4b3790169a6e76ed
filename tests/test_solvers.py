"""The numeric helpers: exactness, gradients, trees and p-values."""

import math
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest

from tests import single_learner as single
from unblend.functions import learn, pvalues, qp
from unblend.functions.linkage import linkage_tree


def support_best(h, l, simplex):
    best, k = math.inf if simplex else 0.0, len(l)
    for r in range(1, k + 1):
        for s in map(list, combinations(range(k), r)):
            sub = h[np.ix_(s, s)]
            if simplex:
                m = np.zeros((r + 1, r + 1))
                m[:r, :r], m[:r, r], m[r, :r] = sub, 1, 1
                z = np.linalg.solve(m, np.r_[l[s], 1])[:r]
            else:
                z = np.linalg.solve(sub, l[s])
            if (z >= -1e-12).all():
                best = min(best, z @ sub @ z - 2 * l[s] @ z)
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_batched_solves_are_exact(k):
    rng = np.random.default_rng(k)
    a, b = rng.normal(size=(120, 9, k)), rng.normal(size=(120, 9))
    h, l = np.einsum("ngi,ngj->nij", a, a), np.einsum("ngi,ng->ni", a, b)
    for solver, simplex in ((qp.simplex_ls, True), (qp.nnls, False)):
        x = solver(h, l)
        assert (x >= 0).all() and (not simplex or np.allclose(x.sum(1), 1))
        for i in range(len(x)):
            assert x[i] @ h[i] @ x[i] - 2 * l[i] @ x[i] == pytest.approx(support_best(h[i], l[i], simplex), abs=1e-8)
            assert np.allclose(solver(h[i : i + 1], l[i : i + 1])[0], x[i], atol=1e-10)


def test_exact_mixtures_are_recovered():
    rng = np.random.default_rng(1)
    a, p = np.abs(rng.normal(size=(40, 4))), np.array([0.5, 0.3, 0.15, 0.05])
    a, b = a[None], (a @ p)[None]
    assert np.allclose(learn.weighted_ls(a, b, np.ones((1, 40)))[0], p, atol=1e-8)
    got = learn.deconvolve(a, b, learn.Config())
    assert np.allclose(got["proportions"][0], p, atol=1e-6) and got["converged"] == [True]
    order = rng.permutation(40)
    again = learn.deconvolve(a[:, order], b[:, order], learn.Config())
    assert np.allclose(again["proportions"], got["proportions"], atol=1e-6)


@pytest.mark.parametrize("sphere", [True, False])
def test_gradient_and_loss_of_learned_weights(sphere):
    rng = np.random.default_rng(2)
    a, p = rng.normal(size=(30, 3)), np.array([0.6, 0.3, 0.1])
    cfg = learn.Config(lambda_hessian=1.0, lambda_avg_gradient=0.7, lambda_residual=1.5, lambda_importance=0.01, lambda3=0.01, lambda4=0.001, sphere=sphere)
    b = a @ p + 0.1 * rng.normal(size=30)
    loss = learn.Loss(a[None], b[None], p[None], np.ones((1, 30)), cfg)
    raw = np.abs(rng.normal(10, 7, 30))
    _, g = loss(raw[None])
    steps = np.array([(loss((raw + 1e-5 * e)[None])[0][0] - loss((raw - 1e-5 * e)[None])[0][0]) / 2e-5 for e in np.eye(30)])
    assert np.abs(steps - g[0]).max() < 1e-6
    start = np.full((1, 30), cfg.baseline)
    w, value = learn.learn_weights(loss, start)
    assert value[0] <= loss(start)[0][0] + 1e-9
    assert w.min() >= cfg.floor - 1e-9 and w.mean() == pytest.approx(cfg.baseline, abs=1e-8)


CONFIGS = [
    learn.Config(),
    learn.Config(lambda_hessian=1.0, lambda_avg_gradient=0.7, lambda_residual=1.5, lambda_importance=0.01, lambda3=0.01, lambda4=0.001),
    learn.Config(sphere=False, fix_mean=False),
]


@pytest.mark.parametrize("cfg", CONFIGS)
@pytest.mark.parametrize("k", [1, 2, 4])
def test_stacks_step_as_single_mixtures_do(cfg, k):
    """Up to rounding: later steps may part where a mixture's path turns on the last bits."""
    rng = np.random.default_rng(k)
    a, p, c = rng.normal(size=(12, 40, k)), rng.dirichlet(np.ones(k), 12), rng.uniform(0.5, 2, (12, 40))
    b = np.einsum("mnk,mk->mn", a, p) + 0.3 * rng.normal(size=(12, 40))
    loss, alone = learn.Loss(a, b, p, c, cfg), [single.Loss(a[i], b[i], p[i], c[i], cfg) for i in range(12)]
    raw = np.abs(rng.normal(10, 7, (12, 40)))
    value, grad = loss(raw)
    for i, f in enumerate(alone):
        v, g = f(raw[i])
        assert value[i] == pytest.approx(v, abs=1e-12) and np.allclose(grad[i], g, atol=1e-12)
    start = np.full((12, 40), cfg.baseline)
    for steps in (1, 2, 6):
        got = learn.lbfgs(loss, start, steps, cfg.learn_tol)
        want = np.stack([single.lbfgs(f, start[i], steps, cfg.learn_tol) for i, f in enumerate(alone)])
        assert np.allclose(got, want, atol=1e-7)
    parts = loss.parts(start)
    assert np.allclose(sum(parts[x] for x in learn.PARTS[:5]), loss(start)[0], atol=1e-10)
    short = replace(cfg, max_iter=1, rounds=1, steps=3)
    done, one = learn.deconvolve(a, b, short, c), [single.deconvolve(a[i], b[i], short, c[i]) for i in range(12)]
    for i, x in enumerate(one):
        assert done["loss"][i] == pytest.approx(x["loss"], abs=1e-8) and done["iterations"][i] == x["iterations"]
        assert np.allclose(done["proportions"][i], x["proportions"], atol=1e-8)
        assert np.allclose(done["weight_stats"][i], x["weight_stats"], atol=1e-5)


@pytest.mark.parametrize("cfg", CONFIGS)
def test_a_mixture_has_the_same_bits_in_any_stack(cfg):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(15, 37, 3))
    b = np.einsum("mnk,mk->mn", a, rng.dirichlet(np.ones(3), 15)) + 0.2 * rng.normal(size=(15, 37))
    whole = learn.deconvolve(a, b, cfg)
    for at in ([3], [14, 0, 7], list(range(5, 15))):
        some = learn.deconvolve(a[at], b[at], cfg)
        for name in ("proportions", "raw", "meta_weights", "loss", *learn.PARTS):
            assert (some[name] == whole[name][at]).all()
        assert some["change_history"] == [whole["change_history"][i] for i in at]


def test_settings_are_checked():
    for wrong in ({"floor": 20.0}, {"floor": 0.0}, {"baseline": -1.0, "floor": -2.0}, {"max_iter": 0}, {"kappa": 0.0}):
        with pytest.raises(ValueError):
            learn.Config(**wrong)


def test_bad_inputs_are_errors():
    with pytest.raises(ValueError):
        learn.deconvolve(np.array([[[1.0, np.nan]]]), np.array([[1.0]]), learn.Config())
    with pytest.raises(ValueError):
        learn.to_simplex(np.array([-1.0, 0.0]))
    assert learn.deconvolve(np.ones((1, 5, 1)), np.arange(5.0)[None], learn.Config())["proportions"].tolist() == [[1.0]]


def test_linkage():
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 2], [6, 6, 2, 0]], float)
    rows = {r[0]: r for r in linkage_tree(["a", "b", "c", "d"], d)}
    assert rows["a"][1] == rows["b"][1] == "merge_1" and rows["c"][1] == "merge_2"
    assert rows["merge_3"][1] is None and rows["merge_3"][5] == pytest.approx(5.5)
    assert rows["a"][6] == rows["b"][6] != rows["c"][6]


def test_normal_tails_all_at_once():
    z = np.r_[np.linspace(-9, 9, 4001), 3.5355339, 30.0, -30.0, np.nan]
    got = pvalues.normal_tails(z)
    assert np.isnan(got[-1]) and got[:-1] == pytest.approx([pvalues.normal_sf(x) for x in z[:-1]], rel=1e-11)


def test_p_values():
    assert pvalues.normal_sf(1.96) == pytest.approx(0.0249979, abs=1e-6)
    assert pvalues.corr_p(0.5, 12) == pytest.approx(0.0978, abs=1e-4)
    assert pvalues.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert pvalues.wilcoxon_greater(15, 5, 0) == pytest.approx(1 / 32)
    assert pvalues.mann_whitney_greater(0, 3, 3, 210.0) == 1.0
    assert pvalues.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
