"""Learned gene weights and weighted deconvolution of stacks of mixtures, in numpy.

A stack is A (mixtures, genes, K) and b (mixtures, genes). All mixtures of a stack go through the loop in step: one
pass of numpy over the stack for each loss, each eigenproblem and each trial of the line searches. A mixture that
is done leaves the passes that follow. Each takes the same steps as it would alone, bit by bit. Everything here is called
inside Spark tasks; ``stack_size`` says how many mixtures of a shape a task should hold at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .qp import simplex_ls


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values that results depend on."""

    tol: float = 0.005
    max_iter: int = 1000
    old_weight: float = 2.5
    weight_floor: float = 1e-12
    lambda_hessian: float = 0.03
    lambda_avg_gradient: float = 0.0
    lambda_residual: float = 0.02
    lambda_importance: float = 0.0
    lambda3: float = 1e-4
    lambda4: float = 1e-5
    kappa: float = 0.1
    epsilon: float = 1e-8
    sphere: bool = True
    importance_epsilon: float = 1e-12
    floor: float = 1.0
    baseline: float = 10.0
    steps: int = 100
    rounds: int = 3
    learn_tol: float = 1e-8
    perturbations: int = 20
    perturb_scale: float = 0.02
    seed: int = 0
    fix_mean: bool = True

    def __post_init__(self):
        if not self.baseline > 0:
            raise ValueError("baseline must be above 0")
        if not 0 < self.floor <= self.baseline:
            raise ValueError("floor must be above 0 and at most the baseline")
        if not self.kappa > 0 or not self.epsilon > 0:
            raise ValueError("kappa and epsilon must be above 0")
        if self.max_iter < 1 or self.rounds < 0 or self.steps < 0 or self.old_weight < 0:
            raise ValueError("max_iter must be 1 or more, rounds, steps and old_weight 0 or more")


#: Pairs of steps that the quasi-Newton method remembers.
MEMORY = 20
#: What a loss is made of.
PARTS = ["hessian_loss", "avg_gradient_loss", "residual_penalty", "importance_loss", "reg_loss", "min_eig", "mean_eig", "max_eig"]


def stack_size(genes: int, k: int, budget: int = 64 << 20) -> int:
    """Mixtures whose arrays stay within so many bytes."""
    return int(max(1, min(256, budget // (8 * max(1, genes) * (2 * MEMORY + 3 * max(1, k) + 24)))))


def to_simplex(x: np.ndarray) -> np.ndarray:
    """Shares of the last axis' sum, negative values as 0."""
    x = np.maximum(np.asarray(x, float), 0.0)
    total = x.sum(-1, keepdims=True)
    if not (total > 0).all():
        raise ValueError("nothing is left of the proportions")
    return x / total


def fit_mean(raw: np.ndarray, floor: float, mean: float, fix: bool) -> tuple[np.ndarray, np.ndarray]:
    """max(floor, h * max(raw, floor)) with the given mean over the last axis, and h.

    The mean grows with h piecewise linearly, so h follows from sorted values: if the k
    largest are above the floor, h is what fills the rest of the mean.
    """
    m = np.maximum(raw, floor)
    if not fix:
        return m, np.ones(m.shape[:-1])
    n = m.shape[-1]
    s = -np.sort(-m, -1)
    k = np.arange(1, n + 1)
    h = (mean * n - floor * (n - k)) / np.cumsum(s, -1)
    ok = h * s >= floor * (1 - 1e-15)
    last = n - 1 - ok[..., ::-1].argmax(-1)
    found = np.take_along_axis(h, last[..., None], -1)[..., 0]
    h = np.where(ok.any(-1), found, floor / s[..., 0])
    return np.maximum(floor, h[..., None] * m), h


def _flat_basis(k: int) -> np.ndarray:
    """Directions along which shares can change."""
    return np.linalg.qr(np.vstack([np.eye(k - 1), -np.ones(k - 1)]))[0]


def _sphere_basis(p: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(tangent basis at the roots of the shares, those roots)."""
    k = p.shape[1]
    u = np.sqrt(np.maximum(p, epsilon))
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    each = np.array([[j for j in range(k) if j != i] for i in range(k)])[u.argmax(1)]
    seed = np.eye(k)[each].transpose(0, 2, 1)
    return np.linalg.qr(seed - u[:, :, None] * np.einsum("mk,mkj->mj", u, seed)[:, None, :])[0], u


class Loss:
    """The weight-learning objective at fixed proportions, with its exact gradient."""

    def __init__(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, confidence: np.ndarray, cfg: Config):
        self.a, self.cfg, self.c = a, cfg, confidence
        p = to_simplex(p)
        self.k = k = a.shape[2]
        fit = (a @ p[:, :, None])[:, :, 0]
        self.residual = (fit - b) ** 2
        self.rows = None
        if k > 1:
            self.flat = _flat_basis(k)
            if cfg.sphere:
                q, u = _sphere_basis(p, cfg.epsilon)
                self.rows = 2.0 * (a * u[:, None, :]) @ q
            else:
                self.rows = a @ self.flat
        base = np.maximum(p, 1e-12)
        base = base / base.sum(1, keepdims=True)
        draws = np.random.default_rng(cfg.seed).normal(0.0, cfg.perturb_scale, (max(1, cfg.perturbations), k))
        other = np.maximum(base[:, None, :] + draws, 1e-12)
        other = (other / other.sum(2, keepdims=True)).mean(1)
        self.drift = fit - (a @ other[:, :, None])[:, :, 0]
        mean, var = a.mean(2), a.var(2)
        score = np.maximum(var / np.maximum(mean, cfg.importance_epsilon), 0.0)
        top = score.max(1, keepdims=True)
        self.importance = np.where(top > 0, score / np.where(top > 0, top, 1.0), 1.0)

    def take(self, at: np.ndarray) -> Loss:
        """The loss of some of the mixtures."""
        if len(at) == len(self.c):
            return self
        out = object.__new__(Loss)
        out.cfg, out.k = self.cfg, self.k
        out.flat = getattr(self, "flat", None)
        for name in ("c", "residual", "importance", "rows", *(("a", "drift") if self.cfg.lambda_avg_gradient else ())):
            have = getattr(self, name)
            setattr(out, name, None if have is None else have[at])
        return out

    def _eigen(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.linalg.eigh(np.swapaxes(self.rows, 1, 2) @ (t[:, :, None] * self.rows))

    def at_weights(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cfg, c = self.cfg, self.c
        t = w * c
        value = cfg.lambda_residual * (self.residual * t).sum(1) - cfg.lambda_importance * (w * self.importance).sum(1)
        grad = cfg.lambda_residual * self.residual * c - cfg.lambda_importance * self.importance
        if self.k > 1:
            e, v = self._eigen(t)
            kept = np.maximum(e, cfg.epsilon)
            value -= cfg.lambda_hessian * np.log(kept + cfg.epsilon).sum(1)
            inner = np.where(e > cfg.epsilon, 1.0 / (kept + cfg.epsilon), 0.0)
            grad = grad - cfg.lambda_hessian * c * (((self.rows @ v) ** 2) @ inner[:, :, None])[:, :, 0]
            if cfg.lambda_avg_gradient:
                g = self._mean_gradient(t)
                value += cfg.lambda_avg_gradient * (g * g).sum(1)
                along = (self.a @ np.swapaxes(g[:, None, :] @ self.flat.T, 1, 2))[:, :, 0]
                grad = grad + 4.0 * cfg.lambda_avg_gradient * c * self.drift * along
        else:
            value -= cfg.lambda_hessian * np.log(1.0 + cfg.epsilon)
        d = w - cfg.baseline
        norm = np.sqrt((d * d).sum(1))
        s = 1.0 / (1.0 + np.exp(-norm / cfg.kappa))
        value += (cfg.lambda3 * s + cfg.lambda4) * norm**2
        grad = grad + (2.0 * (cfg.lambda3 * s + cfg.lambda4) + cfg.lambda3 * s * (1 - s) * norm / cfg.kappa)[:, None] * d
        return value, grad

    def _mean_gradient(self, t: np.ndarray) -> np.ndarray:
        # products of stacks, so that a mixture's bits don't depend on the others
        return (2.0 * ((t * self.drift)[:, None, :] @ self.a) @ self.flat)[:, 0]

    def parts(self, w: np.ndarray) -> dict[str, np.ndarray]:
        """What the loss at these weights adds up from, and the extremes and mean of the curvature's eigenvalues."""
        cfg, t = self.cfg, w * self.c
        if self.k > 1:
            e = np.maximum(self._eigen(t)[0], cfg.epsilon)
            g = self._mean_gradient(t)
        else:
            e, g = np.ones((len(w), 1)), np.zeros((len(w), 1))
        d = ((w - cfg.baseline) ** 2).sum(1)
        return {
            "hessian_loss": -cfg.lambda_hessian * np.log(e + cfg.epsilon).sum(1),
            "avg_gradient_loss": cfg.lambda_avg_gradient * (g * g).sum(1),
            "residual_penalty": cfg.lambda_residual * (self.residual * t).sum(1),
            "importance_loss": -cfg.lambda_importance * (w * self.importance).sum(1),
            "reg_loss": (cfg.lambda3 / (1.0 + np.exp(-np.sqrt(d) / cfg.kappa)) + cfg.lambda4) * d,
            "min_eig": e.min(1),
            "mean_eig": e.mean(1),
            "max_eig": e.max(1),
        }

    def __call__(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cfg = self.cfg
        w, h = fit_mean(raw, cfg.floor, cfg.baseline, cfg.fix_mean)
        value, g = self.at_weights(w)
        if cfg.fix_mean:
            m = np.maximum(raw, cfg.floor)
            h = h[:, None]
            free = h * m > cfg.floor
            total = np.where(free, m, 0.0).sum(1)
            pull = np.where(free, g * m, 0.0).sum(1) / np.where(total > 0, total, 1.0)
            g = np.where(free, h * (g - pull[:, None]), 0.0)
        return value, np.where(raw > cfg.floor, g, 0.0)


class _Pairs:
    """The last steps of each mixture and how its gradient turned on them, newest first."""

    def __init__(self, m: int, n: int):
        self.s, self.y = np.zeros((MEMORY, m, n)), np.zeros((MEMORY, m, n))
        self.r, self.next, self.count = np.zeros((MEMORY, m)), np.zeros(m, int), np.zeros(m, int)

    def push(self, at: np.ndarray, step: np.ndarray, turn: np.ndarray, curve: np.ndarray) -> None:
        slot = self.next[at]
        self.s[slot, at], self.y[slot, at], self.r[slot, at] = step, turn, 1.0 / curve
        self.next[at] = (slot + 1) % MEMORY
        self.count[at] = np.minimum(MEMORY, self.count[at] + 1)

    def direction(self, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        d, k, alphas = -g, self.count[at], []
        for j in range(k.max(initial=0)):
            slot = (self.next[at] - 1 - j) % MEMORY
            al = np.where(j < k, self.r[slot, at], 0.0) * (self.s[slot, at] * d).sum(1)
            alphas.append(al)
            d = d - al[:, None] * self.y[slot, at]
        if alphas:
            slot = (self.next[at] - 1) % MEMORY
            y = self.y[slot, at]
            d = d * np.where(k > 0, (self.s[slot, at] * y).sum(1) / np.maximum((y * y).sum(1), 1e-300), 1.0)[:, None]
        for j in reversed(range(len(alphas))):
            slot = (self.next[at] - 1 - j) % MEMORY
            be = np.where(j < k, self.r[slot, at], 0.0) * (self.y[slot, at] * d).sum(1)
            d = d + self.s[slot, at] * np.where(j < k, alphas[j] - be, 0.0)[:, None]
        return d


def _search(loss: Loss, at: np.ndarray, x: np.ndarray, value: np.ndarray, d: np.ndarray, slope: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step lengths, values, gradients) by a strong Wolfe line search; where it finds none, of its last trial."""
    low, high = np.zeros(len(at)), np.full(len(at), np.inf)
    new, grad = np.full(len(at), np.inf), np.zeros_like(d)
    todo, last = np.arange(len(at)), t.copy()
    for _ in range(25):
        v, g = loss.take(at[todo])(x[todo] + t[todo, None] * d[todo])
        new[todo], grad[todo], last[todo] = v, g, t[todo]
        along, down = (g * d[todo]).sum(1), slope[todo]
        far = ~np.isfinite(v) | (v > value[todo] + 1e-4 * t[todo] * down)
        short = ~far & (along < 0.9 * down)
        past = ~far & ~short & (np.abs(along) > -0.9 * down)
        high[todo[far | past]] = t[todo[far | past]]
        low[todo[short]] = t[todo[short]]
        todo = todo[far | short | past]
        if not len(todo):
            break
        t[todo] = np.where(np.isfinite(high[todo]), 0.5 * (low[todo] + high[todo]), 2.0 * t[todo])
    return last, new, grad


def lbfgs(loss: Loss, x: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Minimise each mixture's loss by limited-memory quasi-Newton steps."""
    x = x.copy()
    value, g = loss(x)
    pairs, live = _Pairs(*x.shape), np.ones(len(x), bool)
    for it in range(steps):
        live &= np.abs(g).max(1) > tol
        at = np.flatnonzero(live)
        if not len(at):
            break
        d = pairs.direction(at, g[at])
        slope = (g[at] * d).sum(1)
        up = slope >= 0
        if up.any():
            d[up], pairs.count[at[up]] = -g[at[up]], 0
            slope[up] = -(d[up] ** 2).sum(1)
        t = np.minimum(1.0, 1.0 / np.abs(g[at]).sum(1)) if it == 0 else np.ones(len(at))
        t, new, grad = _search(loss, at, x[at], value[at], d, slope, t)
        good = new <= value[at]
        live[at[~good]] = False
        at, t, new, grad, d = at[good], t[good], new[good], grad[good], d[good]
        step, turn, change = t[:, None] * d, grad - g[at], value[at] - new
        x[at], value[at], g[at] = x[at] + step, new, grad
        curve, size = (step * turn).sum(1), (turn * turn).sum(1)
        keep = curve > 1e-10 * size + 1e-300
        pairs.push(at[keep], step[keep], turn[keep], curve[keep])
        live[at[(np.abs(step).max(1, initial=0.0) <= tol) | (change <= tol)]] = False
    return x


def learn_weights(loss: Loss, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the genes for the loss's proportions, and their loss; each mixture's best round is kept."""
    cfg = loss.cfg
    fit = lambda raw: fit_mean(raw, cfg.floor, cfg.baseline, cfg.fix_mean)[0]
    norm = lambda x: np.maximum(np.sqrt((x * x).sum(1)), 1e-12)
    best = fit(before)
    last, best_value, last_value = best.copy(), np.full(len(best), np.inf), np.full(len(best), np.nan)
    at = np.arange(len(best))
    for _ in range(cfg.rounds):
        own = loss.take(at)
        x = fit(lbfgs(own, last[at], cfg.steps, cfg.learn_tol))
        value = own(x)[0]
        better = value < best_value[at]
        best[at[better]], best_value[at[better]] = x[better], value[better]
        moved = np.sqrt(((x - last[at]) ** 2).sum(1)) / norm(last[at])
        gained = np.abs(value - last_value[at]) / np.maximum(np.abs(last_value[at]), 1e-12)
        last[at], last_value[at] = x, value
        at = at[~((moved < cfg.learn_tol) & (gained < cfg.learn_tol))]
        if not len(at):
            break
    return best, best_value


def weighted_ls(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    aw = np.swapaxes(a * w[:, :, None], 1, 2)
    return simplex_ls(aw @ a, (aw @ b[:, :, None])[:, :, 0])


def deconvolve(a: np.ndarray, b: np.ndarray, cfg: Config, confidence: np.ndarray | None = None) -> dict[str, np.ndarray | list]:
    """Weights and proportions by turns until the averaged proportions settle, for every mixture of a stack.

    proportions, raw (before they are made shares), initial_proportions, iterations, converged, change_history (a list a
    mixture), meta_weights, weight_stats, loss and what it is made of (``PARTS``).
    """
    m, n = b.shape
    if not n or not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise ValueError("signature and bulk must be finite and not empty")
    c = np.maximum(np.ones((m, n)) if confidence is None else confidence, cfg.weight_floor)
    x = weighted_ls(a, b, np.ones((m, n)))
    first, w, loss = to_simplex(x), np.full((m, n), cfg.baseline), np.zeros(m)
    parts = {p: np.zeros(m) for p in PARTS}
    history: list[list[float]] = [[] for _ in range(m)]
    at = np.arange(m)
    for _ in range(cfg.max_iter):
        goal = Loss(a[at], b[at], x[at], c[at], cfg)
        w[at], loss[at] = learn_weights(goal, w[at])
        new = weighted_ls(a[at], b[at], np.maximum(w[at] * c[at], cfg.weight_floor))
        averaged = (new + cfg.old_weight * x[at]) / (cfg.old_weight + 1)
        change = np.sqrt(((averaged - x[at]) ** 2).sum(1))
        for i, v in zip(at.tolist(), change.tolist()):
            history[i].append(v)
        x[at] = averaged
        done = np.array([len(history[i]) == cfg.max_iter for i in at.tolist()]) | (change <= cfg.tol)
        if done.any():
            for p, v in goal.parts(w[at]).items():
                parts[p][at[done]] = v[done]
        at = at[~done]
        if not len(at):
            break
    total = np.maximum(w * c, cfg.weight_floor)
    return {
        "proportions": to_simplex(x),
        "raw": x,
        "initial_proportions": first,
        "iterations": [len(h) for h in history],
        "converged": [h[-1] <= cfg.tol for h in history],
        "change_history": history,
        "meta_weights": w,
        "weight_stats": np.stack([w.min(1), w.mean(1), w.max(1), total.min(1), total.mean(1), total.max(1)], 1),
        "loss": loss,
        **parts,
    }
