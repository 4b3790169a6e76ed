"""The weight learner for one mixture at a time, which the stacks of the library are compared with."""

from __future__ import annotations

import numpy as np

from unblend.functions.learn import Config
from unblend.functions.qp import simplex_ls


def to_simplex(x: np.ndarray) -> np.ndarray:
    x = np.maximum(np.asarray(x, float), 0.0)
    total = x.sum()
    if not total > 0:
        raise ValueError("nothing is left of the proportions")
    return x / total


def fit_mean(raw: np.ndarray, floor: float, mean: float, fix: bool) -> tuple[np.ndarray, float]:
    """max(floor, h * max(raw, floor)) with the given mean, and h.

    The mean grows with h piecewise linearly, so h follows from sorted values: if the k
    largest are above the floor, h is what fills the rest of the mean.
    """
    m = np.maximum(raw, floor)
    if not fix:
        return m, 1.0
    n = len(m)
    s = np.sort(m)[::-1]
    above = np.cumsum(s)
    k = np.arange(1, n + 1)
    h = (mean * n - floor * (n - k)) / above
    ok = h * s >= floor * (1 - 1e-15)
    h = h[np.flatnonzero(ok)[-1]] if ok.any() else floor / s[0]
    return np.maximum(floor, h * m), float(h)


def _basis(p: np.ndarray, sphere: bool, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(tangent basis, scaling u of the columns; ones without the sphere form)."""
    k = len(p)
    plain = np.vstack([np.eye(k - 1), -np.ones(k - 1)])
    if not sphere:
        return np.linalg.qr(plain)[0], np.ones(k)
    u = np.sqrt(np.maximum(p, epsilon))
    u = u / np.linalg.norm(u)
    seed = np.delete(np.eye(k), np.abs(u).argmax(), 1)
    return np.linalg.qr(seed - np.outer(u, u @ seed))[0], u


class Loss:
    """The weight-learning objective at fixed proportions, with its exact gradient."""

    def __init__(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, confidence: np.ndarray, cfg: Config):
        self.a, self.cfg, self.c = a, cfg, confidence
        p = to_simplex(p)
        k = a.shape[1]
        self.residual = (a @ p - b) ** 2
        self.k = k
        if k > 1:
            q, u = _basis(p, cfg.sphere, cfg.epsilon)
            self.rows = (2.0 if cfg.sphere else 1.0) * (a * u) @ q
            self.flat = np.linalg.qr(np.vstack([np.eye(k - 1), -np.ones(k - 1)]))[0]
        rng = np.random.default_rng(cfg.seed)
        base = np.maximum(p, 1e-12)
        base = base / base.sum()
        other = [base + rng.normal(0.0, cfg.perturb_scale, k) for _ in range(max(1, cfg.perturbations))]
        other = [np.maximum(x, 1e-12) / np.maximum(x, 1e-12).sum() for x in other]
        self.drift = a @ p - a @ np.mean(other, 0)
        mean, var = a.mean(1), a.var(1)
        score = np.maximum(var / np.maximum(mean, cfg.importance_epsilon), 0.0)
        self.importance = score / score.max() if score.max() > 0 else np.ones(len(b))

    def at_weights(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        cfg, c = self.cfg, self.c
        t = w * c
        value = cfg.lambda_residual * float(self.residual @ t) - cfg.lambda_importance * float(w @ self.importance)
        grad = cfg.lambda_residual * self.residual * c - cfg.lambda_importance * self.importance
        if self.k > 1:
            e, v = np.linalg.eigh(self.rows.T @ (t[:, None] * self.rows))
            kept = np.maximum(e, cfg.epsilon)
            value -= cfg.lambda_hessian * float(np.log(kept + cfg.epsilon).sum())
            inner = np.where(e > cfg.epsilon, 1.0 / (kept + cfg.epsilon), 0.0)
            grad = grad - cfg.lambda_hessian * c * (((self.rows @ v) ** 2) @ inner)
            if cfg.lambda_avg_gradient:
                g = self.flat.T @ (2.0 * (self.a.T @ (t * self.drift)))
                value += cfg.lambda_avg_gradient * float(g @ g)
                grad = grad + 4.0 * cfg.lambda_avg_gradient * c * self.drift * (self.a @ (self.flat @ g))
        else:
            value -= cfg.lambda_hessian * float(np.log(1.0 + cfg.epsilon))
        d = w - cfg.baseline
        norm = float(np.linalg.norm(d))
        s = 1.0 / (1.0 + np.exp(-norm / cfg.kappa))
        value += (cfg.lambda3 * s + cfg.lambda4) * norm**2
        grad = grad + (2.0 * (cfg.lambda3 * s + cfg.lambda4) + cfg.lambda3 * s * (1 - s) * norm / cfg.kappa) * d
        return value, grad

    def __call__(self, raw: np.ndarray) -> tuple[float, np.ndarray]:
        cfg = self.cfg
        w, h = fit_mean(raw, cfg.floor, cfg.baseline, cfg.fix_mean)
        value, g = self.at_weights(w)
        m = np.maximum(raw, cfg.floor)
        if cfg.fix_mean:
            free = h * m > cfg.floor
            total = m[free].sum()
            g = np.where(free, h * g - (h * float(g[free] @ m[free]) / total if total > 0 else 0.0), 0.0)
        return value, np.where(raw > cfg.floor, g, 0.0)


def lbfgs(f, x: np.ndarray, steps: int, tol: float, memory: int = 20) -> np.ndarray:
    """Minimise by limited-memory quasi-Newton steps with a strong Wolfe line search."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for it in range(steps):
        if np.abs(g).max() <= tol:
            break
        d = -g
        if pairs:
            alphas = []
            for s, y, r in reversed(pairs):
                al = r * float(s @ d)
                alphas.append(al)
                d = d - al * y
            s, y, _ = pairs[-1]
            d = d * (float(s @ y) / float(y @ y))
            for (s, y, r), al in zip(pairs, reversed(alphas)):
                d = d + s * (al - r * float(y @ d))
        slope = float(g @ d)
        if slope >= 0:
            d, slope, pairs = -g, -float(g @ g), []
        t = min(1.0, 1.0 / np.abs(g).sum()) if it == 0 else 1.0
        low, high, new = 0.0, np.inf, None
        for _ in range(25):
            new = f(x + t * d)
            if not np.isfinite(new[0]) or new[0] > value + 1e-4 * t * slope:
                high = t
            elif float(new[1] @ d) < 0.9 * slope:
                low = t
            elif abs(float(new[1] @ d)) > -0.9 * slope:
                high = t
            else:
                break
            t = 0.5 * (low + high) if np.isfinite(high) else 2.0 * t
        if new is None or not new[0] <= value:
            break
        step, turn = t * d, new[1] - g
        change = value - new[0]
        x, value, g = x + step, new[0], new[1]
        curve = float(step @ turn)
        if curve > 1e-10 * float(turn @ turn) + 1e-300:
            pairs = [*pairs[-memory + 1 :], (step, turn, 1.0 / curve)]
        if np.abs(step).max() <= tol or change <= tol:
            break
    return x


def learn_weights(a: np.ndarray, b: np.ndarray, p: np.ndarray, confidence: np.ndarray, before: np.ndarray, cfg: Config) -> tuple[np.ndarray, float]:
    """Weights of the genes for these proportions, and their loss; the best round is kept."""
    loss = Loss(a, b, p, confidence, cfg)
    x = fit_mean(before, cfg.floor, cfg.baseline, cfg.fix_mean)[0]
    best, best_value = x, np.inf
    last, last_value = x, None
    for _ in range(cfg.rounds):
        x = fit_mean(lbfgs(loss, x, cfg.steps, cfg.learn_tol), cfg.floor, cfg.baseline, cfg.fix_mean)[0]
        value = loss(x)[0]
        if value < best_value:
            best, best_value = x, value
        moved = np.linalg.norm(x - last) / max(np.linalg.norm(last), 1e-12)
        gained = np.inf if last_value is None else abs(value - last_value) / max(abs(last_value), 1e-12)
        last, last_value = x, value
        if moved < cfg.learn_tol and gained < cfg.learn_tol:
            break
    return best, float(best_value)


def weighted_ls(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    aw = a * w[:, None]
    return simplex_ls((aw.T @ a)[None], (aw.T @ b)[None])[0]


def deconvolve(a: np.ndarray, b: np.ndarray, cfg: Config, confidence: np.ndarray | None = None) -> dict:
    """Weights and proportions by turns until the averaged proportions settle."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()) or not len(b):
        raise ValueError("signature and bulk must be finite and not empty")
    c = np.maximum(np.ones(len(b)) if confidence is None else confidence, cfg.weight_floor)
    x = weighted_ls(a, b, np.ones(len(b)))
    first, w = to_simplex(x), np.full(len(b), cfg.baseline)
    history: list[float] = []
    while len(history) < cfg.max_iter:
        w, loss = learn_weights(a, b, x, c, w, cfg)
        new = weighted_ls(a, b, np.maximum(w * c, cfg.weight_floor))
        averaged = (new + cfg.old_weight * x) / (cfg.old_weight + 1)
        history.append(float(np.linalg.norm(averaged - x)))
        x = averaged
        if history[-1] <= cfg.tol:
            break
    total = np.maximum(w * c, cfg.weight_floor)
    return {
        "proportions": to_simplex(x),
        "initial_proportions": first,
        "iterations": len(history),
        "converged": bool(history and history[-1] <= cfg.tol),
        "change_history": history,
        "meta_weights": w,
        "weight_stats": [w.min(), w.mean(), w.max(), total.min(), total.mean(), total.max()],
        "loss": loss,
    }
