"""Logistic regression on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, free: int = 0, rounds: int = 40) -> np.ndarray:
    """Weights that minimise the logistic loss of ``x @ w`` against the (soft)
    labels ``y`` plus ``l2 / 2 * |w|^2``, by damped Newton steps.  The last
    ``free`` weights (an intercept) are not penalised."""
    n, d = x.shape
    penalty = np.full(d, l2)
    if free:
        penalty[-free:] = 1e-9

    def loss(w):
        s = x @ w
        return float((np.logaddexp(0, s) - y * s).sum() + 0.5 * (penalty * w * w).sum())
    w, now = np.zeros(d), None
    for _ in range(rounds):
        now = loss(w) if now is None else now
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        after = loss(w)
        if now - after < 1e-7 * (1 + abs(now)):
            break
        now = after
    return w
