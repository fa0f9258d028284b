"""Forecasts of the return of a cluster's composite over the next `horizon` positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import spread

#: Asymptotic 5 % value of the Dickey-Fuller statistic with a constant.
CRITICAL = -2.86


def composites(train: DataFrame, clusters: DataFrame) -> DataFrame:
    """window_id, cluster, pos, r: the mean return of a cluster's assets; nulls and NaN are left out."""
    keys = [c for c in ("window_id", "asset") if c in clusters.columns]
    r = F.nanvl("r", F.lit(None))
    return train.join(clusters, keys).groupBy("window_id", "cluster", "pos").agg(F.avg(r).alias("r"))


def historical_mean(series: DataFrame, horizon: int) -> DataFrame:
    """window_id, cluster, expected_return: the mean times the horizon, 0 without any return."""
    return series.groupBy("window_id", "cluster").agg(F.coalesce(F.avg("r") * horizon, F.lit(0.0)).alias("expected_return"))


def _flat(r: np.ndarray) -> bool:
    return np.allclose(r, r[0])


def cubic_step(r: np.ndarray, horizon: int) -> float | None:
    """How far a least-squares cubic through the cumulative returns goes in `horizon` steps after the last one.

    This is the smoothing cubic of smoothing factor n for as long as its squared residuals sum to n at most; None beyond that.
    """
    n, total = len(r), np.cumsum(r)
    scale = lambda t: np.vander(2.0 * np.asarray(t, float) / (n - 1) - 1, 4)
    base = scale(np.arange(n))
    fit = np.linalg.lstsq(base, total, rcond=None)[0]
    if np.sum((total - base @ fit) ** 2) > n:
        return None
    last, ahead = scale([n - 1, n - 1 + horizon]) @ fit
    return float(ahead - last)


def _regress(r: np.ndarray, lags: int, start: int) -> tuple[float, float]:
    """AIC and the statistic of the lagged level, from differences number `start` on."""
    step = np.diff(r)
    rows = np.arange(start, len(step))
    x = np.column_stack([r[rows], np.ones(len(rows)), *[step[rows - k] for k in range(1, lags + 1)]])
    y = step[rows]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = float(np.sum((y - x @ beta) ** 2))
    n, k = x.shape
    error = np.sqrt(rss / (n - k) * np.linalg.pinv(x.T @ x)[0, 0])
    return n * np.log(max(rss, 1e-300) / n) + 2 * k, float(beta[0] / error) if error > 0 else -np.inf


def difference_order(r: np.ndarray, least: int = 20) -> int:
    """0 for a series that the augmented Dickey-Fuller test with a constant calls stationary, 1 otherwise; 0 for short or constant ones.

    Lags, 12 * (n / 100) ** 0.25 at most, are chosen by AIC over one sample.
    """
    n = len(r)
    if n < least or _flat(r):
        return 0
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    lags = min(range(most + 1), key=lambda k: _regress(r, k, most)[0])
    return int(_regress(r, lags, lags)[1] >= CRITICAL)


def _steady(x: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from any numbers, by way of partial autocorrelations."""
    out = np.zeros(0)
    for k, r in enumerate(np.tanh(x)):
        out = np.append(out - r * out[::-1], r) if k else np.array([r])
    return out


def _covariances(ar: np.ndarray, ma: np.ndarray, lags: int) -> np.ndarray:
    """Autocovariances of lags 0 .. lags - 1 for innovations of variance 1: the psi weights' products, as far as they count."""
    size = lags + 100
    psi = np.zeros(size)
    psi[0] = 1.0
    for k in range(1, size):
        back = min(k, len(ar))
        psi[k] = (ma[k - 1] if k <= len(ma) else 0.0) + (ar[:back] @ psi[k - back : k][::-1] if back else 0.0)
    return np.array([psi[: size - k] @ psi[k:] for k in range(lags)])


def _least(f, start: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """A simplex search for the least value of f."""
    n = len(start)
    if not n:
        return start, f(start)
    points = np.vstack([start, start + 0.4 * np.eye(n)])
    values = np.array([f(p) for p in points])
    for _ in range(steps * n):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if values[-1] - values[0] < 1e-6:
            break
        mid = points[:-1].mean(0)
        new = 2 * mid - points[-1]
        got = f(new)
        if got < values[0]:
            far = 3 * mid - 2 * points[-1]
            if (more := f(far)) < got:
                new, got = far, more
        elif got >= values[-2]:
            new = 0.5 * (mid + (new if got < values[-1] else points[-1]))
            if (inner := f(new)) < min(got, values[-1]):
                got = inner
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = new, got
    return points[np.argmin(values)], float(values.min())


def arma_fit(y: np.ndarray, p: int, q: int, mean: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
    """AIC, autoregressive and moving-average coefficients and mean of the Gaussian ARMA of greatest exact likelihood; level and
    variance follow from the others in closed form."""
    n = len(y)
    at = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))

    def parts(x):
        ar, ma = _steady(x[:p]), -_steady(x[p:])
        low = np.linalg.cholesky(_covariances(ar, ma, n)[at] + 1e-10 * np.eye(n))
        u = np.linalg.solve(low, np.column_stack([y, np.ones(n)]))
        level = float(u[:, 0] @ u[:, 1] / (u[:, 1] @ u[:, 1])) if mean else 0.0
        rest = u[:, 0] - level * u[:, 1]
        return ar, ma, level, max(float(rest @ rest) / n, 1e-300), 2 * np.log(np.diag(low)).sum()

    def loss(x):
        try:
            *_, spread, size = parts(x)
        except np.linalg.LinAlgError:
            return 1e300
        return n * (np.log(2 * np.pi * spread) + 1) + size

    x, value = _least(loss, np.zeros(p + q))
    ar, ma, level, _, _ = parts(x)
    return value + 2 * (p + q + mean + 1), ar, ma, level


def arima_step(r: np.ndarray, horizon: int, max_p: int = 2, max_q: int = 2) -> tuple[float, int, int, int] | None:
    """Sum of the next `horizon` expected values and the order (p, d, q) of least AIC, the first in order of p and q among equals. d is
    `difference_order`; series that aren't differenced have a mean."""
    d = difference_order(r)
    y = np.diff(r) if d else r
    scale = y.std() or 1.0
    best = None
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            aic, ar, ma, level = arma_fit(y / scale, p, q, not d)
            if np.isfinite(aic) and (best is None or aic < best[0] - 1e-9):
                best = aic, ar, ma, level * scale, p, q
    if best is None:
        return None
    _, ar, ma, level, p, q = best
    n = len(y)
    cov = _covariances(ar, ma, n + horizon)
    at = np.abs(np.subtract.outer(np.arange(n + horizon), np.arange(n)))
    ahead = level + cov[at[n:]] @ np.linalg.solve(cov[at[:n]] + 1e-10 * np.eye(n), y - level)
    if d:
        ahead = r[-1] + np.cumsum(ahead)
    return float(ahead.sum()), p, d, q


def forecasts(series: DataFrame, horizon: int, least: int = 30, model: str = "spline", max_p: int = 2, max_q: int = 2) -> DataFrame:
    """window_id, cluster, expected_return, model, p, d, q, fallback: the step of the cubic ("spline") or of the best ARIMA (any other model),
    with the order of differences of each series.

    Series of under `least` returns, constant ones, and those that the model can't fit get their mean times the horizon, one
    without returns gets 0. A group holds one window's composite of one cluster.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("pos")["r"].dropna().to_numpy(float)
        order, d = (None, None), difference_order(r)
        if not len(r):
            value, name = 0.0, "empty"
        else:
            step = None
            if len(r) >= least and not _flat(r):
                if model == "spline":
                    step = cubic_step(r, horizon)
                elif found := arima_step(r, horizon, max_p, max_q):
                    step, order, d = found[0], (found[1], found[3]), found[2]
            value, name = (float(r.mean() * horizon), "historical_mean") if step is None else (step, "spline" if model == "spline" else "arima")
        return pdf[["window_id", "cluster"]].head(1).assign(expected_return=value, model=name, p=order[0], d=d, q=order[1], fallback=name in ("empty", "historical_mean"))

    schema = "window_id int, cluster int, expected_return double, model string, p int, d int, q int, fallback boolean"
    return spread(series.select("window_id", "cluster", "pos", "r"), "window_id", "cluster").groupBy("window_id", "cluster").applyInPandas(run, schema)
