"""Weights of least variance, or of mean against variance, under a cap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Settings
from ..sources.panel import spread


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's (2004) estimate: the sample covariance drawn towards a multiple of the identity. Rows are observations."""
    n, p = x.shape
    x = x - x.mean(0)
    cov = x.T @ x / n
    level = np.trace(cov) / p
    spread = ((cov - level * np.eye(p)) ** 2).sum()
    noise = max(0.0, (((x**2).T @ x**2).sum() / n - (cov**2).sum()) / n)
    share = min(1.0, noise / spread) if spread > 0 else 0.0
    return (1 - share) * cov + share * level * np.eye(p)


def onto_capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point with parts in 0 .. cap and sum 1, by bisection on what is taken from each part."""
    low, high = v.min() - cap - 1, v.max()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(v - (low + high) / 2, 0, cap)


def optimal_weights(x: np.ndarray, cap: float, mean_share: float = 0.0, shrink_means: bool = False, steps: int = 5000) -> np.ndarray:
    """Argument of least w'Cw - mean_share * w'm over 0 <= w <= cap, sum 1: projected gradient with momentum that restarts when it
    points uphill. If caps can't hold 1 or x isn't finite, all weights are equal."""
    n = x.shape[1]
    equal = np.full(n, 1.0 / n)
    if cap * n < 1 - 1e-12 or not np.isfinite(x).all():
        return equal
    cov, mean = shrunk_covariance(x), x.mean(0) * (0.5 if shrink_means else 1.0)
    top = 2 * np.linalg.eigvalsh(cov)[-1]
    if top <= 0:
        return equal
    w, ahead, t = equal, equal, 1.0
    for _ in range(steps):
        slope = 2 * cov @ ahead - mean_share * mean
        new = onto_capped_simplex(ahead - slope / top, cap)
        if slope @ (new - w) > 0:
            ahead, t = w, 1.0
            new = onto_capped_simplex(w - (2 * cov @ w - mean_share * mean) / top, cap)
        if np.abs(new - w).max() < 1e-13:
            w = new
            break
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w / w.sum()


def optimised(train: DataFrame, s: Settings, mean_share: float = 0.0, shrink_means: bool = False) -> DataFrame:
    """window_id, asset, w. A window's rows, its length times its assets, are one group."""
    kind = train.schema["asset"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="pos", columns="asset", values="r").sort_index(axis=1)
        w = optimal_weights(x.to_numpy(float), s.cap(x.shape[1]), mean_share, shrink_means)
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "asset": x.columns.to_numpy(), "w": w})

    return spread(train.select("window_id", "asset", "pos", "r"), "window_id").groupBy("window_id").applyInPandas(run, f"window_id int, asset {kind}, w double")
