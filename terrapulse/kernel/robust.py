"""Robust harmonic regression by reweighted least squares with Tukey's bisquare, and the outlier screen built on it."""

from __future__ import annotations

import numpy as np

from terrapulse.kernel.lasso import OMEGA
from terrapulse.options import YEAR, RobustOptions

EPS = np.finfo(float).eps
#: Smallest values that the scale estimate leaves out.
TRIM = 4


def screen_basis(days: np.ndarray) -> np.ndarray:
    """(n, 5): one cycle a year, one cycle in the window's whole years, and a constant."""
    t = np.asarray(days, float)
    slow = OMEGA / np.ceil((t[-1] - t[0]) / YEAR)
    return np.column_stack([np.cos(OMEGA * t), np.sin(OMEGA * t), np.cos(slow * t), np.sin(slow * t), np.ones(len(t))])


def mad(residuals: np.ndarray, options: RobustOptions = RobustOptions()) -> float:
    """Median of absolute residuals without the four smallest, over 0.6745; NaN where none are left."""
    kept = np.sort(np.abs(residuals))[TRIM:]
    return float(np.median(kept)) / options.scale if len(kept) else float("nan")


def weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least squares of least norm."""
    root = np.sqrt(w)
    return np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]


def leverage_factor(x: np.ndarray) -> np.ndarray:
    q = np.linalg.qr(x)[0]
    return 1 / np.sqrt(1 - np.minimum(0.9999, np.nan_to_num((q**2).sum(1), nan=0.9999)))


def fit(x: np.ndarray, y: np.ndarray, options: RobustOptions = RobustOptions()) -> np.ndarray:
    """Coefficients."""
    beta = weighted(x, y, np.ones(len(y)))
    if mad(y - x @ beta, options) < EPS:
        return beta
    factor = leverage_factor(x)
    for _ in range(1, options.max_iter):
        r = (y - x @ beta) * factor
        z = np.abs(r / max(EPS * y.std(), mad(r, options))) / options.tune
        old, beta = beta, weighted(x, y, np.where(z < 1, (1 - z**2) ** 2, 0.0))
        if np.abs(beta - old).max() < options.tolerance:
            break
    return beta


def fit_lanes(x: np.ndarray, y: np.ndarray, n: np.ndarray, options: RobustOptions) -> np.ndarray:
    """Coefficients of many windows of full rank at once; x (lanes, rows, 5) and y (lanes, rows) are 0 beyond each lane's n rows."""
    lanes, rows = y.shape
    real = np.arange(rows) < n[:, None]

    def solve(w: np.ndarray) -> np.ndarray:
        xw = x * w[:, :, None]
        return np.linalg.solve(xw.transpose(0, 2, 1) @ x, (xw.transpose(0, 2, 1) @ y[:, :, None]))[:, :, 0]

    def scale(r: np.ndarray) -> np.ndarray:
        s = np.sort(np.where(real, np.abs(r), np.inf), axis=1)
        m = n - TRIM
        at = np.arange(lanes)
        return 0.5 * (s[at, TRIM + (m - 1) // 2] + s[at, TRIM + m // 2]) / options.scale

    beta = solve(real.astype(float))
    final = beta.copy()
    spread = np.sqrt(((y - (y.sum(1) / n)[:, None]) ** 2 * real).sum(1) / n)
    q = np.linalg.qr(x)[0]
    factor = 1 / np.sqrt(1 - np.minimum(0.9999, (q**2).sum(2)))
    going = scale(y - (x @ beta[:, :, None])[:, :, 0]) >= EPS
    for _ in range(1, options.max_iter):
        if not going.any():
            break
        r = (y - (x @ beta[:, :, None])[:, :, 0]) * factor
        z = np.abs(r) / np.maximum(np.maximum(EPS * spread, scale(r)), 1e-300)[:, None] / options.tune
        w = np.where(real & (z < 1), (1 - z**2) ** 2, 0.0)
        w[~going] = real[~going]
        try:
            new = solve(w)
        except np.linalg.LinAlgError:
            new = np.stack([weighted(a[:k], b[:k], c[:k]) for a, b, c, k in zip(x, y, w, n)])
        final[going] = new[going]
        going &= np.abs(new - beta).max(1) >= options.tolerance
        beta = final.copy()
    return final


def screen(requests: list[tuple[np.ndarray, np.ndarray, np.ndarray]], options: RobustOptions = RobustOptions(max_iter=5)) -> list[np.ndarray]:
    """For each (days, values (bands, n), limits by band): which observations lie beyond the limit in any band."""
    out: list = [None] * len(requests)
    full = []
    for k, (days, y, limits) in enumerate(requests):
        if len(days) > TRIM + 5 and days[-1] - days[0] > YEAR:
            full.append(k)
        else:  # both cycles coincide: columns depend on each other
            x = screen_basis(days)
            betas = np.stack([fit(x, v, options) for v in y])
            out[k] = (np.abs(betas @ x.T - y) > limits[:, None]).any(0)
    if full:
        bands, ns = len(requests[0][1]), np.array([len(requests[k][0]) for k in full])
        rows = int(ns.max())
        t, ys = np.zeros((len(full), rows)), np.zeros((len(full), bands, rows))
        for i, k in enumerate(full):
            t[i, : ns[i]], ys[i, :, : ns[i]] = requests[k][:2]
        slow = OMEGA / np.ceil((t[np.arange(len(full)), ns - 1] - t[:, 0]) / YEAR)[:, None]
        xs = np.stack([np.cos(OMEGA * t), np.sin(OMEGA * t), np.cos(slow * t), np.sin(slow * t), np.ones(t.shape)], 2)
        xs[np.arange(rows) >= ns[:, None]] = 0.0
        betas = fit_lanes(np.repeat(xs, bands, 0), ys.reshape(-1, rows), np.repeat(ns, bands), options).reshape(len(full), bands, 5)
        far = (np.abs(betas @ xs.transpose(0, 2, 1) - ys) > np.stack([requests[k][2] for k in full])[:, :, None]).any(1)
        for i, k in enumerate(full):
            out[k] = far[i, : ns[i]]
    return out
