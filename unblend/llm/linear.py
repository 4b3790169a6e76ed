"""A small logistic regression on sparse rows, for models that fit a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_cols: int, target: np.ndarray, l2: float = 1.0, steps: int = 150
) -> tuple[np.ndarray, float]:
    """Weights and intercept for targets in [0, 1] by accelerated gradient steps.

    Entries are (row, column, value). Columns are scaled to a root mean square of
    one over the rows, so one step size and one penalty suit all.
    """
    n = max(1, len(target))
    scale = np.sqrt(np.bincount(cols, values**2, n_cols) / n)
    scale[scale == 0] = 1.0
    x = values / scale[cols]
    rate = float(np.clip(target.mean() if len(target) else 0.5, 1e-4, 1 - 1e-4))
    w, b = np.zeros(n_cols), float(np.log(rate / (1 - rate)))
    wv, bv = w.copy(), b
    # the curvature is at most a quarter of the largest squared row norm
    step = 4.0 / (1.0 + np.percentile(np.bincount(rows, x**2, n), 99) + 4 * l2 / n) if len(rows) else 1.0
    for k in range(steps):
        z = np.bincount(rows, x * wv[cols], n) + bv
        error = sigmoid(z) - target
        grad = np.bincount(cols, x * error[rows], n_cols) / n + l2 / n * wv
        w2, b2 = wv - step * grad, bv - step * float(error.mean())
        m = k / (k + 3)
        wv, bv = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w / scale, b
