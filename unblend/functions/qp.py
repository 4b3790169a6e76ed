"""Many small least-squares problems at once, from their normal equations.

A problem is x'Hx - 2 l'x with H (K, K) and l (K). Stacks of them are solved by
enumerating nothing: a primal active-set method works on each row of the stack with
its own set of free variables, all rows advancing together in numpy.
"""

from __future__ import annotations

import numpy as np

#: Relative size below which a gain counts as rounding.
TINY = 1e-11


def _solve_free(h: np.ndarray, l: np.ndarray, free: np.ndarray, simplex: bool) -> np.ndarray:
    """Minimisers over the free variables (others 0), with sum 1 if ``simplex``."""
    n, k = l.shape
    size = k + 1 if simplex else k
    a = np.zeros((n, size, size))
    b = np.zeros((n, size))
    mask = free[:, :, None] & free[:, None, :]
    a[:, :k, :k] = np.where(mask, h, 0.0)
    scale = np.maximum(np.einsum("nii->ni", h).max(1), 1e-300)
    idx = np.arange(k)
    a[:, idx, idx] += np.where(free, 1e-13 * scale[:, None], scale[:, None])
    b[:, :k] = np.where(free, l, 0.0)
    if simplex:
        a[:, :k, k] = a[:, k, :k] = np.where(free, scale[:, None], 0.0)
        b[:, k] = scale
        none = ~free.any(1)
        a[none, k, k] = 1.0
    return np.linalg.solve(a, b[:, :, None])[:, :k, 0]


def _active_set(h: np.ndarray, l: np.ndarray, x: np.ndarray, simplex: bool, rounds: int) -> np.ndarray:
    n, k = l.shape
    x = x.copy()
    free = x > 0
    todo = np.ones(n, bool)
    scale = np.maximum(np.abs(h).max((1, 2)), np.abs(l).max(1)) + 1e-300
    for _ in range(rounds):
        i = np.flatnonzero(todo)
        if not len(i):
            break
        goal = _solve_free(h[i], l[i], free[i], simplex)
        goal = np.where(free[i], goal, 0.0)
        step = goal - x[i]
        falls = free[i] & (goal < 0)
        ratio = np.where(falls, x[i] / np.where(falls, x[i] - goal, 1.0), np.inf)
        alpha = np.minimum(1.0, ratio.min(1))
        blocked = alpha < 1.0
        x[i] = np.maximum(0.0, x[i] + alpha[:, None] * step)
        hit = falls & (ratio <= alpha[:, None] * (1 + 1e-14)) & blocked[:, None]
        free[i] &= ~hit
        x[i] = np.where(free[i], x[i], 0.0)
        # those that reached their goal: free the variable whose release gains most
        full = ~blocked
        j = i[full]
        if len(j):
            slope = np.einsum("nij,nj->ni", h[j], x[j]) - l[j]
            level = (
                np.where(free[j], slope, 0.0).sum(1) / np.maximum(1, free[j].sum(1)) if simplex else np.zeros(len(j))
            )
            gain = np.where(free[j], 0.0, level[:, None] - slope)
            best = gain.argmax(1)
            more = gain[np.arange(len(j)), best] > TINY * scale[j]
            free[j[more], best[more]] = True
            todo[j[~more]] = False
    return x


def simplex_ls(h: np.ndarray, l: np.ndarray) -> np.ndarray:
    """argmin x'Hx - 2 l'x over x >= 0 with sum 1, for stacks (n, K, K) and (n, K)."""
    n, k = l.shape
    if k == 1:
        return np.ones((n, 1))
    start = np.zeros((n, k))
    one = (np.einsum("nii->ni", h) - 2 * l).argmin(1)
    start[np.arange(n), one] = 1.0
    x = _active_set(h, l, start, True, 40 + 20 * k)
    total = x.sum(1, keepdims=True)
    return x / np.where(total > 0, total, 1.0)


def nnls(h: np.ndarray, l: np.ndarray) -> np.ndarray:
    """argmin x'Hx - 2 l'x over x >= 0, for stacks."""
    return _active_set(h, l, np.zeros_like(l), False, 40 + 20 * l.shape[1])
