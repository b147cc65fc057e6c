"""Small logistic fits on a bounded sample, run on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def platt(z: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the calibrated probability sigmoid(slope * z + offset)."""
    scale = float(np.std(z)) or 1.0
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    high = (y.sum() + 1.0) / (y.sum() + 2.0)
    low = 1.0 / ((1 - y).sum() + 2.0)
    target = np.where(y > 0, high, low)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (p - target) + ridge * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_sparse(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n_columns: int, l2: float = 1e-5, rounds: int = 80, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on sparse rows, by Adam on the whole sample."""
    w, b = np.zeros(n_columns), 0.0
    m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=w[columns] * values, minlength=len(y)) + b
        error = (sigmoid(z) - y) * balance
        g = np.append(np.bincount(columns, weights=error[rows] * values, minlength=n_columns) + l2 * w, error.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)
