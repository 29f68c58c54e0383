"""Harmonic LASSO fits, many at once.

All bands of all requests of a round with as many terms are lanes of one coordinate descent over their centred Gram matrices: a cycle costs a
handful of array operations however many pixels a batch holds. A lane's result is taken as soon as it converges, and the last lanes go on in plain numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from terrapulse.options import MAX_TERMS, YEAR, LassoOptions

OMEGA = 2 * np.pi / YEAR
#: Lanes up to which plain numbers are faster than arrays.
FEW_LANES = 21


def basis(days: np.ndarray, terms: int = 8) -> np.ndarray:
    """(7, n): the day, then cosine and sine of one, two and three cycles a year; rows beyond ``terms`` (which counts the intercept) are 0."""
    t = np.asarray(days, float)
    out = np.zeros((MAX_TERMS, len(t)))
    out[0] = t
    for k in range(1, terms // 2):
        out[2 * k - 1], out[2 * k] = np.cos(k * OMEGA * t), np.sin(k * OMEGA * t)
    return out


@dataclass
class Fit:
    """Of one window: arrays by band."""

    iterations: np.ndarray
    intercept: np.ndarray
    weights: np.ndarray  # (bands, 7)
    residuals: np.ndarray  # (bands, n)
    rmse: np.ndarray

    def predict(self, days: np.ndarray) -> np.ndarray:
        return self.at(basis(days))

    def at(self, x: np.ndarray) -> np.ndarray:
        """Values where the basis has been worked out."""
        return self.weights @ x + self.intercept[:, None]


def rmse(residuals: np.ndarray, terms: int) -> np.ndarray:
    """Root of the residual sum of squares over n - terms; infinite where that is 0, NaN below."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt((residuals**2).sum(-1) / float(residuals.shape[-1] - terms))


def descend(gram: np.ndarray, xy: np.ndarray, yy: np.ndarray, n: np.ndarray, options: LassoOptions) -> tuple[np.ndarray, np.ndarray]:
    """Weights (rows, lanes) and cycles of cyclic coordinate descent from zero; gram (rows, rows, lanes), xy (rows, lanes)."""
    rows, lanes = xy.shape
    weights, cycles = np.zeros((rows, lanes)), np.full(lanes, options.max_iter + 1)
    own, going = np.arange(lanes), np.ones(lanes, bool)
    w, c = np.zeros((rows, lanes)), xy.copy()  # c: inner products of columns and residuals
    norm = gram[np.arange(rows), np.arange(rows)]
    # Weights of columns without any variance stay 0.
    limit, over = np.where(norm > 0, options.alpha * n, np.inf), np.where(norm > 0, norm, 1.0)
    used = [j for j in range(rows) if norm[j].any()]
    for cycle in range(1, options.max_iter + 1):
        before = w.copy()
        for j in used:
            rho = norm[j] * w[j]
            rho += c[j]
            new = np.maximum(rho, -limit[j])
            np.minimum(new, limit[j], out=new)
            np.subtract(rho, new, out=new)
            new /= over[j]
            c -= gram[:, j] * (new - w[j])
            w[j] = new
        step, top = np.abs(w - before).max(0), np.abs(w).max(0)
        s = np.flatnonzero(going & (step <= options.tolerance * np.maximum(top, 1.0)))
        if len(s):
            ws, cs, ns, ys = w[:, s], c[:, s], n[s], yy[s]
            fitted = (ws * xy[:, s]).sum(0)
            rr = ys - fitted - (ws * cs).sum(0)  # squared residuals: y'y - 2 w'X'y + w'Gw, and Gw = X'y - c
            scale = np.minimum(1.0, options.alpha * ns / np.maximum(np.abs(cs).max(0), 1e-300))
            primal = rr / (2 * ns) + options.alpha * np.abs(ws).sum(0)
            dual = scale * (ys - fitted) / ns - scale**2 * rr / (2 * ns)
            done = s[primal - dual <= options.tolerance * ys / ns]
            if len(done):
                weights[:, own[done]], cycles[own[done]] = w[:, done], cycle
                going[done] = False
                left = int(going.sum())
                if not left:
                    return weights, cycles
                if left <= FEW_LANES and np.isfinite(yy[going]).all():
                    for k in np.flatnonzero(going):
                        v, cycles[own[k]] = descend_one(gram[:, :, k].tolist(), xy[:, k].tolist(), float(yy[k]), float(n[k]), options, w[:, k].tolist(), c[:, k].tolist(), cycle)
                        weights[:, own[k]] = v
                    return weights, cycles
                if left < 0.75 * len(own):
                    own, w, c, gram, xy, yy, n, norm, limit, over = (v[..., going] for v in (own, w, c, gram, xy, yy, n, norm, limit, over))
                    going = np.ones(left, bool)
    weights[:, own[going]] = w[:, going]
    return weights, cycles


def descend_one(gram: list[list[float]], xy: list[float], yy: float, n: float, options: LassoOptions, w: list[float] | None = None, c: list[float] | None = None, past: int = 0) -> tuple[list[float], int]:
    """``descend`` for one lane in plain numbers: the same steps in the same order, without the cost of array calls on few lanes.

    It goes on from weights w and inner products c after ``past`` cycles where these are given.
    """
    used = [j for j in range(len(xy)) if gram[j][j] > 0]
    columns = [(j, gram[j][j], [(k, gram[k][j]) for k in used]) for j in used]
    w, c, floor, tolerance = w or [0.0] * len(xy), c or list(xy), options.alpha * n, options.tolerance
    for cycle in range(past + 1, options.max_iter + 1):
        step = top = 0.0
        for j, norm, column in columns:
            old = w[j]
            rho = c[j] + norm * old
            if rho > floor:
                new = (rho - floor) / norm
            elif -rho > floor:
                new = -((-rho - floor) / norm)
            else:
                new = 0.0
            if new != old:
                delta = new - old
                w[j] = new
                for k, g in column:
                    c[k] -= g * delta
                if delta < 0:
                    delta = -delta
                if delta > step:
                    step = delta
            if new < 0:
                new = -new
            if new > top:
                top = new
        if step <= tolerance * (top if top > 1.0 else 1.0):
            fitted = sum(a * b for a, b in zip(w, xy))
            rr = yy - fitted - sum(a * b for a, b in zip(w, c))
            scale = min(1.0, floor / max(max(map(abs, c)), 1e-300))
            primal = rr / (2 * n) + options.alpha * sum(map(abs, w))
            dual = scale * (yy - fitted) / n - scale**2 * rr / (2 * n)
            if primal - dual <= tolerance * yy / n:
                return w, cycle
    return w, options.max_iter + 1


def solve(gram: np.ndarray, xy: np.ndarray, yy: np.ndarray, n: np.ndarray, options: LassoOptions) -> tuple[np.ndarray, np.ndarray]:
    """Weights (windows, bands, rows) and cycles (windows, bands); gram (windows, rows, rows), xy (windows, rows, bands), yy (windows, bands), n (windows)."""
    windows, rows, bands = xy.shape
    gram, xy = np.repeat(gram, bands, 0).transpose(1, 2, 0), xy.transpose(1, 0, 2).reshape(rows, -1)
    yy, n, lost = yy.ravel(), np.repeat(n.astype(float), bands), np.isnan(xy).any(0)
    if lost.any() and options.max_iter > 1:  # values are missing: every weight that is stepped to is NaN and no step is small
        w, cycles = np.where(gram[np.arange(rows), np.arange(rows)] > 0, np.nan, 0.0), np.full(len(n), options.max_iter + 1)
        if not lost.all():
            w[:, ~lost], cycles[~lost] = _descended(gram[:, :, ~lost], xy[:, ~lost], yy[~lost], n[~lost], options)
    else:
        w, cycles = _descended(gram, xy, yy, n, options)
    return np.ascontiguousarray(w.T).reshape(windows, bands, rows), cycles.reshape(windows, bands)


def _descended(gram: np.ndarray, xy: np.ndarray, yy: np.ndarray, n: np.ndarray, options: LassoOptions) -> tuple[np.ndarray, np.ndarray]:
    if len(n) <= FEW_LANES and np.isfinite(yy).all():
        lanes = [descend_one(g, x, y, m, options) for g, x, y, m in zip(gram.transpose(2, 0, 1).tolist(), xy.T.tolist(), yy.tolist(), n.tolist())]
        return np.array([v for v, _ in lanes]).T, np.array([k for _, k in lanes])
    return descend(np.ascontiguousarray(gram), xy, yy, n, options)


def fit_many(requests: list[tuple], options: LassoOptions = LassoOptions()) -> list[Fit]:
    """One fit for each (days, values (bands, n), terms), or (days, values, terms, basis of these days); windows of one shape are prepared together."""
    shapes: dict[tuple, list[int]] = {}
    for k, (_, y, terms, *_) in enumerate(requests):
        shapes.setdefault((terms, *y.shape), []).append(k)
    alike: dict[tuple, list[tuple]] = {}
    for (terms, bands, n), own in shapes.items():
        rows = max(1, 2 * (terms // 2) - 1)
        x = np.concatenate([requests[k][3][:rows] if len(requests[k]) > 3 else basis(requests[k][0], terms)[:rows] for k in own]).reshape(-1, rows, n)
        y = np.concatenate([requests[k][1] for k in own]).reshape(-1, bands, n)
        xm, ym = x.sum(2) / n, y.sum(2) / n
        xc, yc = x - xm[:, :, None], y - ym[:, :, None]
        alike.setdefault((rows, bands), []).append((own, terms, x, y, xm, ym, xc @ xc.transpose(0, 2, 1), xc @ yc.transpose(0, 2, 1), (yc**2).sum(2), np.full(len(own), n)))
    out: list = [None] * len(requests)
    for (rows, bands), groups in alike.items():
        w, cycles = solve(*(np.concatenate([g[i] for g in groups]) for i in (6, 7, 8, 9)), options)
        at = 0
        for own, terms, x, y, xm, ym, *_ in groups:
            weights = np.zeros((len(own), bands, MAX_TERMS))
            weights[:, :, :rows] = v = w[at : at + len(own)]
            intercept = ym - (v @ xm[:, :, None])[:, :, 0]
            residuals = y - (v @ x + intercept[:, :, None])
            for k, *fit in zip(own, cycles[at : at + len(own)], intercept, weights, residuals, rmse(residuals, terms)):
                out[k] = Fit(*fit)
            at += len(own)
    return out
